"""The queries that have SQL give its rows; every registered query of the subpackage runs on the smallest tables."""

import math
import os

import duckdb
import pytest

from vertexflow.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages")
COLUMNS = {
    "op1_permutation": "query_id rank vec_id score", "op2_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_fertility": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op5_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op6_surrogates": "doc_id text",
    "op7_minhash": "doc_id n_shingles component_id kept", "op8_pitman_yor": "doc_id held_out n_tokens n_known train_tokens base_score score", "op9_wrappers": "page_id url text n_chars",
    "op10_language": "doc_id held_out lang_pred score",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    found = df.collect()
    if "doc_id" in df.columns and name != "op5_packing":
        assert len(found) == db.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    if name in queries.ORACLES:
        columns = sorted(df.columns)
        relation = db.sql(queries.ORACLES[name])
        assert sorted(relation.columns) == columns
        expected = sorted(relation.select(*(f'"{c}"' for c in columns)).fetchall(), key=repr)
        assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == expected


def test_base_columns_of_the_quality_rules(spark, db):
    """n_words, word_chars, n_symbols and n_dup_lines by SQL."""
    rows = queries.op4_fertility(spark, SF).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines").collect()
    expected = db.sql(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY 1, 2)
SELECT doc_id, len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')), length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g')), length(t) - length(translate(t, '#*$%&|<>', '')),
CAST(coalesce((SELECT sum(n - 1) FROM l WHERE l.doc_id = t.doc_id), 0) AS BIGINT) FROM t""").fetchall()
    assert sorted(map(tuple, rows)) == sorted(expected)


def test_scores_are_logarithms(spark):
    rows = queries.op8_pitman_yor(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows) and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
