"""WARC archives with revisit resolution.

Writing: every page becomes a record. Payload digests are shuffled with their headers alone; of records with equal payloads
of at least `least` bytes that with the largest id is the response, all others become revisits that refer to it
and carry no payload. Records get fresh headers (the date is that of the run, or given) and each is a gzip member of its own, so that
other tools can cut one out by its offset; every file begins with a warcinfo record. Spark's text sink writes the members as they are,
committed task by task, on any file system that Spark writes. Between its lines it puts an empty gzip member, which holds nothing. Then the
files get their names, `.warc.gz`.

Reading: an archive is read whole and in order by one task (gzip does not split), cut at the terminator, and put together
again by Content-Length, so payloads may hold terminators or headers themselves. Digests are computed again from the payloads.
Revisits are resolved by a join of their WARC-Refers-To with the record ids of responses; heads are written once for both sides.

A null payload counts as empty, a null url is left out; equal pages with one id are written each for itself. Ties for the
original are rows with the same id: all of them are responses. A page without an id is a response, and no other refers to it. An
empty table gives an empty archive and result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, kind_of, lean, small_side, stash, work_dir

END = "\r\n\r\n"
#: An empty gzip member.
NOTHING = bytes.fromhex("1f8b080000000000000303000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("-", F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def resolve(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest and, for revisits, original_id and original_url."""
    payload = F.coalesce("html", F.lit(""))
    headed = pages.select("page_id", F.regexp_replace("url", r"[\r\n]+", " ").alias("url"), payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    headers = headed.where(F.col("payload_bytes") >= least).select("payload_digest", F.struct("page_id", "url").alias("at"))
    shared = headers.where("at.page_id IS NOT NULL").groupBy("payload_digest").agg(F.max("at").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = headed.join(small_side(shared, "shared"), "payload_digest", "left")
    revisit = F.col("original.page_id") != F.col("page_id")
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, F.col("original.page_id")).alias("original_id"), F.when(revisit, F.col("original.url")).alias("original_url"),
    )


def record(date: str) -> Column:
    """The text of a record, without its terminator, of a row of resolve()."""
    nothing = F.lit("")
    revisit = F.col("original_id").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), nothing)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.concat(http, F.when(revisit, nothing).otherwise(F.col("html")))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(nothing),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("original_id"), F.col("payload_digest")))).otherwise(nothing),
        F.when(revisit, line("WARC-Refers-To-Target-URI", F.col("original_url"))).otherwise(nothing),
        line("X-Page-ID", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit(END), body,
    )


def member(record: bytes) -> bytes:
    """A gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def warcinfo(date: str, name: str) -> bytes:
    body = "software: vertexflow\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}"
    return f"{head}{END}{body}{END}".encode()


def write(pages: DataFrame, path: str, least: int = 1000, date: str | None = None, per_file: int = 200_000) -> None:
    """Writes the archives of pages (page_id, url, html) into the new folder `path`, at most so many records a file."""
    spark = pages.sparkSession
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    schema = pa.schema([("value", pa.binary())])

    def members(batches):
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out = []
                for record in batch.column(0).slice(at, 1000).to_pylist():
                    if rows % per_file == 0:  # the writer begins a file here
                        out.append(member(warcinfo(date, f"{path}/{part}/{rows}")))
                        rows += 1
                    out.append(member(record + END.encode()))
                    rows += 1
                yield arrow_batch(schema, out)

    rows = resolve(pages, least).select(record(date).cast("binary").alias("value")).mapInArrow(lean(members), kind_of(schema))
    rows.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", per_file).text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for file in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "part-*.txt")):
        old = file.getPath()
        files.rename(old, spark._jvm.org.apache.hadoop.fs.Path(at, old.getName().removesuffix(".txt") + ".warc.gz"))


def parse(fragments):
    """(headers, block) of the records in an iterable of byte strings that the terminator separated."""
    end, buffer, need, headers, spare = END.encode(), bytearray(), 0, None, False
    for fragment in fragments:
        buffer += fragment
        buffer += end
        while True:
            if headers is None:
                if spare and buffer.startswith(end):
                    # a file's last block ended in \r\n: cut at the first terminator, its rest was a fragment that had none of its own
                    del buffer[: len(end)]
                    spare = False
                if not buffer:
                    break
                at = buffer.find(end)
                if at < 0:
                    break
                head = bytes(buffer[:at]).decode()
                if not head.startswith("WARC/"):
                    raise ValueError(f"no record begins with {head[:60]!r}")
                headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in head.split("\r\n")[1:])}
                need = int(headers["content-length"]) + len(end)
                del buffer[: at + len(end)]
            if len(buffer) < need:
                break
            block = bytes(buffer[: need - len(end)])
            yield headers, block
            del buffer[:need]
            headers, spare = None, block.endswith(b"\r\n")
    if headers is not None or buffer:
        raise ValueError("the last record is cut short")


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record_id, record_type, page_id, url, refers_to_id, payload_bytes, payload_digest, payload); null payload for revisits.

    Digests are checked in any case; without `payloads` the payload itself stays out."""
    names = "record_id string, record_type string, page_id long, url string, refers_to_id string, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))])

    def run(batches):
        def row(headers, block):
            http, _, payload = block.partition(END.encode())
            digest = headers.get("warc-payload-digest", "sha1:")[5:]
            if headers["warc-type"] == "response":
                found = hashlib.sha1(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"{headers['warc-record-id']}: payload digest {found}, not {digest}")
                size = len(payload)
            else:
                size = payload = None
            page = headers.get("x-page-id")
            return headers["warc-record-id"], headers["warc-type"], int(page) if page else None, headers.get("warc-target-uri"), headers.get("warc-refers-to"), size, digest, *([payload] if payloads else [])

        rows, held = [], 0
        for headers, block in parse(x.encode() for b in batches for x in b.column(0).to_pylist()):
            if headers["warc-type"] == "warcinfo":
                continue
            rows.append(row(headers, block))
            held += len(block)
            if held > 8_000_000 or len(rows) >= 5000:
                yield arrow_batch(schema, *zip(*rows))
                rows, held = [], 0
        if rows:
            yield arrow_batch(schema, *zip(*rows))

    return spark.read.schema("value string").option("lineSep", END).text(path).mapInArrow(lean(run), names)


def revisits(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of read(); revisits resolved by their originals."""
    heads = stash(records.drop("payload"), "heads")
    originals = heads.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("o_id"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest")).dropDuplicates(["refers_to_id"])
    # responses refer to nothing: keys of their own keep them from meeting in one task
    keyed = heads.withColumn("refers_to_id", F.coalesce("refers_to_id", F.concat(F.lit("none "), F.coalesce("record_id", F.lit("")))))
    joined = keyed.join(originals, "refers_to_id", "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "o_bytes").alias("payload_bytes"), F.coalesce("o_digest", "payload_digest").alias("payload_digest"), "record_type", F.col("o_id").alias("refers_to"))


def archive_path(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
