"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of characters other than space and \t..\r.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Most bytes of an Arrow batch between Spark and Python, unless the session has a bound of its own below Spark's 64 MB.
BATCH_BYTES = 2 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def lower_az(text: str) -> str:
    """Lower-cases A-Z only; other letters keep their case."""
    return text.encode().lower().decode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The application's folder within the shared folder of the cluster; a temporary one only on one machine, where none is named (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/vertexflow-shared"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def stash(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    if int(spark.conf.get(_BATCHES).rstrip("b")) == 64 << 20:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vf_path = path
    return out


def stash_parts(df: DataFrame, name: str, by: str, values: list[int]) -> list[DataFrame]:
    """stash() in one folder for each value of the column `by`, so that parts can be dropped apart; well compressed, for large tables."""
    whole = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).option("compression", "zstd").parquet(whole)
    out, schema = [], df.drop(by).schema
    for value in values:
        path = f"{whole}/{by}={value}"
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(at)
        out.append(df.sparkSession.read.schema(schema).parquet(path) if there else df.sparkSession.createDataFrame([], schema))
        out[-1]._vf_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: it does when their plans are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def drop(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        if df is not None and hasattr(df, "_vf_path"):
            _delete(df.sparkSession, df._vf_path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application's operators wrote; results that were not written elsewhere go with it."""
    _delete(spark, work_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame, name: str, rows: int = 200_000, size: int = 16_000_000) -> DataFrame:
    """A side of a join, written and measured: broadcast if it has at most so many rows and bytes of strings, else joined as it is.

    Without it the adaptive planner learns that the side is small when the other side has already been shuffled."""
    written = stash(df, name)
    texts = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in written.dtypes if kind in ("string", "binary")]
    n, held = written.agg(F.count("*"), sum(texts, F.lit(0))).first()
    return F.broadcast(written) if n <= rows and held <= size else written


def give_back() -> None:
    """Returns what a finished task held to the system: Python workers are reused, and two of them share an executor with its heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextlib.contextmanager
def task_memory():
    """What a task holds. Its tables only grow, and full passes of the collector over them cost more than the work itself: they wait for the end, where all is given back."""
    before = gc.get_threshold()
    gc.set_threshold(100_000, 20, 1_000_000)
    try:
        yield
    finally:
        gc.set_threshold(*before)
        give_back()


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a mapping over batches, with its caches and tables given back when a partition ends."""

    def mapped(batches):
        with task_memory():
            yield from run(batches)

    return mapped


def arrow_rows(batches, *names, rows: int = 1000, size: int = 4 << 20):
    """The named columns as Python lists, at most `rows` rows and about `size` bytes at a time (one row at least): long texts are copied in small portions."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        each = max(1, min(rows, size * batch.num_rows // max(1, sum(c.nbytes for c in columns))))
        for at in range(0, batch.num_rows, each):
            yield [c.slice(at, each).to_pylist() for c in columns]


def arrow_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def text_map(start: Callable[[], Callable], schema: pa.Schema, *names: str):
    """A column function over texts and other columns: start() makes, once a partition, the function from a row's values to a tuple in `schema`.

    It is called non-deterministic so that a filter on its result and a selection of it share one evaluation."""
    @F.arrow_udf(kind_of(schema))
    def mapped(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        with task_memory():
            make = start()
            for part in parts:
                part = part if isinstance(part, tuple) else (part,)
                each = max(1, min(1000, (4 << 20) * len(part[0]) // max(1, sum(c.nbytes for c in part))))
                out = [make(*row) for at in range(0, len(part[0]), each) for row in zip(*(c.slice(at, each).to_pylist() for c in part))]
                columns = zip(*out) if out else [[]] * len(schema)
                yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], fields=list(schema))
                del out, columns
            del make

    return mapped.asNondeterministic()(*names)


_KINDS = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary", pa.int32(): "int"}


def kind_of(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


class Memo(dict):
    """A bounded cache of a pure function in two generations: a full one becomes the old one, from which what is used again moves on."""

    def __init__(self, make, limit: int = 150_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


def crc32_of_id(column: str):
    """crc32 of the decimal digits of an integer column."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
