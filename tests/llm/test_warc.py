import gzip
import hashlib

import pytest

from vertexflow.llm import warc
from vertexflow.llm.queries import OP3_SQL

BIG = "<p>é" + "x" * 1200
PAGES = [
    (1, "http://a/", BIG), (2, "http://b/", BIG), (9, None, BIG), (3, "http://c/", "small"), (4, "http://d/", "small"), (5, None, None), (6, "http://e/\r\nX: y", ""),
    (7, "http://f/", "a\r\n\r\nWARC/1.1\r\n\r\n\r\nb\r\n"), (8, "http://g/", "\r\n\r\n" * 400), (10, "http://h/", "\r\n\r\n" * 400), (11, "u", "y" * 999), (12, "u", "y" * 999), (13, "u", "z" * 1000), (14, "u", "z" * 1000),
    (15, "long", "q" * 300_000),
]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    warc.write(spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, payload_digest string").repartition(3), path)
    return path


def test_round_trip(spark, archive):
    import duckdb

    pages = [(i, u, h) for i, u, h in PAGES]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = sorted(tuple(r[c] for c in columns) for r in warc.revisits(warc.read(spark, archive)).collect())
    assert found == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({OP3_SQL})").fetchall())
    payloads = {r["page_id"]: r["payload"] for r in warc.read(spark, archive).collect()}
    for i, _, h in PAGES:
        assert payloads[i] is None and i in (1, 2, 8, 13) or bytes(payloads[i]) == (h or "").encode()


def test_archives_are_plain_warc(archive):
    import glob

    texts = [gzip.open(f).read() for f in glob.glob(f"{archive}/*.gz")]
    records = [r for t in texts for r in warc.parse(t.removesuffix(b"\r\n\r\n").split(b"\r\n\r\n"))]
    assert sum(h["warc-type"] == "warcinfo" for h, _ in records) == len(texts)
    records = [r for r in records if r[0]["warc-type"] != "warcinfo"]
    assert len(records) == len(PAGES)
    ids = {h["warc-record-id"] for h, _ in records}
    assert len(ids) == len(PAGES)
    for headers, block in records:
        assert len(block) == int(headers["content-length"]) and block.startswith(b"HTTP/1.1 200 OK\r\n")
        if headers["warc-type"] == "revisit":
            assert headers["warc-refers-to"] in ids and headers["warc-profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n")
        else:
            payload = block.split(b"\r\n\r\n", 1)[1]
            assert headers["warc-payload-digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        list(warc.parse([b"WARC/1.1\r\nContent-Length: 9", b"abc"]))
    with pytest.raises(ValueError):
        list(warc.parse([b"HTTP/1.1 200 OK", b""]))


def test_repeated_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", BIG), (1, "u", BIG), (0, "v", BIG)], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "a"))
    rows = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.revisits(warc.read(spark, str(tmp_path / "a"))).collect())
    assert rows == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    warc.write(df.limit(0), str(tmp_path / "b"))
    assert warc.revisits(warc.read(spark, str(tmp_path / "b"))).count() == 0


def test_last_records_that_end_in_a_line_break(spark, tmp_path):
    htmls = ["abc\r\n", "\r\n", "x\r\n\r\n\r\n", "y\r\n\r\n", "z\r", "\n"]
    pages = [(k, f"http://{k}/", h) for k, h in enumerate(htmls)]
    for k, page in enumerate(pages):
        warc.write(spark.createDataFrame([page], "page_id long, url string, html string"), str(tmp_path / f"one{k}"))
        assert [bytes(r["payload"]) for r in warc.read(spark, str(tmp_path / f"one{k}")).collect()] == [page[2].encode()]
    # several such files that one task reads
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "all"), per_file=1)
    found = warc.read(spark, str(tmp_path / "all")).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in found} == dict(enumerate(htmls))


def test_a_record_can_be_cut_out_by_its_offset(archive):
    import glob
    import zlib

    found = 0
    for file in glob.glob(f"{archive}/*.warc.gz"):
        data, kinds = open(file, "rb").read(), []
        while data:
            one = zlib.decompressobj(31)
            text = one.decompress(data)
            data = one.unused_data
            if text:  # between records there are empty members
                assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
                (headers, block) = next(iter(warc.parse(text.removesuffix(b"\r\n\r\n").split(b"\r\n\r\n"))))
                assert int(headers["content-length"]) == len(block) and not headers["warc-date"].startswith("2000")
                kinds.append(headers["warc-type"])
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
        found += len(kinds) - 1
    assert found == len(PAGES)


def test_pages_without_ids_are_responses(spark, tmp_path):
    html = "<p>" + "same " * 400
    df = spark.createDataFrame([(None, "http://a/", html), (None, "http://b/", html), (3, "http://c/", html), (2, "http://d/", html)], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/out", per_file=3)
    rows = warc.revisits(warc.read(spark, f"file://{tmp_path}/out")).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in rows) == [(0, "response", None), (0, "response", None), (2, "revisit", 3), (3, "response", None)]
