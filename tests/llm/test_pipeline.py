import os

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from vertexflow.llm import queries

SF = "/root/testdata/sf0.001"


def test_registration():
    found = entry_point.queries()
    for n in range(1, 11):
        assert len([q for q in found if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in found and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_keep_the_columns_and_work_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    count, ids = docs.count(), {r[0] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns, name
        rows = out.count()
        now = {r[0] for r in out.select("doc_id").collect()}
        assert now <= ids and (k == 4 or rows <= count)
        assert len(now) > 0.5 * len(ids)
        docs, ids, count = out, now, rows
    assert corpus_pipeline.run(spark, SF).count() == count
