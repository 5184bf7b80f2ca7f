"""Edge lists: comment lines, a header of the vertex and edge counts, then one edge per line with an optional weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import Graph

#: Comment lines start with one of these, after white space.
COMMENT = "#%"
SPACE = " \t\n\x0b\f\r"


def numbered_lines(spark: SparkSession, path: str, comments: str = COMMENT, blank: bool = False) -> DataFrame:
    """(part, at, value): lines without comments (all lines, if comments is empty). Parts are the splits of the files, by name and offset; `at` follows the lines in a part.

    A split is read in order by one task, so increasing ids of an unshuffled scan are enough; no global sort is needed.
    """
    part = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"))
    lines = spark.read.text(path).select("value", part.alias("part")).withColumn("at", F.monotonically_increasing_id())
    start = F.substring(F.ltrim("value", F.lit(SPACE)), 1, 1)
    kept = lines.where(~start.isin(*comments)) if comments else lines
    return kept if blank else kept.where(F.trim("value") != "")


def first_line(lines: DataFrame) -> Row | None:
    """The first of numbered lines; an aggregate with one row."""
    return lines.agg(F.min(F.struct("part", "at", "value")).alias("x")).first()["x"]


def after(line: Row) -> Column:
    """Whether a line comes after the first one: `at` differs between all lines of a scan."""
    return F.col("at") != line["at"]


def _numbers(column: str) -> Column:
    return F.split(single_spaced(column), " ")


def single_spaced(column: str) -> Column:
    """A text with one blank for each run of white space, none around it; only lines that need it meet the pattern."""
    x = F.col(column)
    plain = ~F.contains(x, F.lit("  "))
    for c in SPACE[1:]:
        plain = plain & ~F.contains(x, F.lit(c))
    return F.trim(F.when(plain, x).otherwise(F.regexp_replace(x, r"\s+", " ")))


def read_edge_list(spark: SparkSession, path: str, n: int | None = None, unit_weights: bool = False, header: bool | None = None, check: bool = True) -> Graph:
    """The graph of an edge list: `n m`, then `src dst [weight]`, 0-based, in any order.

    header=False reads a file without a header (then give n). unit_weights gives every edge the weight 1 and ignores the
    third number; else weight is null where it is missing. check compares the edge count with the header's and the ids with
    n, and refuses malformed lines; a missing file raises in any case.
    """
    with_header = header if header is not None else True
    if not with_header and n is None:
        raise ValueError("a file without a header needs n")
    lines = numbered_lines(spark, path)
    expected = None
    body = lines
    if with_header:
        first = first_line(lines)
        if first is None:
            raise ValueError(f"{path} has no header")
        parts = first["value"].split()
        if len(parts) < 2 or not all(p.isdigit() for p in parts[:2]):
            raise ValueError(f"malformed header {first['value']!r}")
        n, expected = (int(parts[0]) if n is None else n), int(parts[1])
        body = lines.where(after(first))
    x = _numbers("value")
    src, dst, weight = (F.try_element_at(x, F.lit(k)).try_cast("long") for k in (1, 2, 3))
    edges = body.select(src.alias("src"), dst.alias("dst"), (F.lit(1) if unit_weights else weight.cast("int")).alias("weight"), "value")
    if not check:
        return Graph.of(edges.drop("value"), n)
    bad = F.col("src").isNull() | F.col("dst").isNull()
    outside = ~bad & ~(F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1))
    # the lines are read and split once: the check and the graph share what it keeps
    edges = edges.select("src", "dst", "weight", F.when(bad | outside, F.col("value")).alias("wrong")).persist()
    try:
        found = edges.agg(F.count("*").alias("m"), F.min(F.when(bad, F.col("wrong"))).alias("bad"), F.min(F.when(outside, F.col("wrong"))).alias("outside")).first()
        if found["bad"] is not None:
            raise ValueError(f"malformed edge {found['bad']!r}")
        if found["outside"] is not None:
            raise ValueError(f"edge {found['outside']!r} leaves 0..{n - 1}")
        if expected is not None and found["m"] != expected:
            raise ValueError(f"{found['m']} edges, but the header says {expected}")
        return Graph.of(edges.drop("wrong"), n, stage=False)
    finally:
        edges.unpersist()


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of all lines of a folder's files in name order, from 0: counts per split, which are few, and places within them."""
    lines = numbered_lines(spark, path, comments="", blank=True)
    return with_numbers(lines).select("line", "value")


#: The most splits whose counts are put in order on the driver.
MOST_PARTS = 100_000


def with_numbers(lines: DataFrame) -> DataFrame:
    """numbered_lines with `line`, their rank, and without `part`.

    In a split whose lines were all kept, `at` runs without gaps, so places are differences; only splits with gaps are sorted.
    """
    sizes = lines.groupBy("part").agg(F.count("*").alias("_n"), F.min("at").alias("_first"), F.max("at").alias("_last"))
    rows = sizes.limit(MOST_PARTS + 1).collect()
    if len(rows) > MOST_PARTS:
        before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        starts = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        own = W.partitionBy("part").orderBy("at")
        return lines.join(starts, "part").withColumn("line", F.col("_start") + F.row_number().over(own) - 1).drop("_start", "part")
    total, known = 0, []
    for r in sorted(rows, key=lambda r: (r["part"]["file"].encode(), r["part"]["offset"])):
        known.append((r["_first"] >> 33, r["_first"], r["_last"], total, r["_last"] - r["_first"] + 1 == r["_n"]))
        total += r["_n"]
    parts = lines.sparkSession.createDataFrame(known, "_task long, _first long, _last long, _start long, _whole boolean")
    # the upper bits of `at` are the task that read the line: a few splits each, in ranges of `at`
    here = (F.shiftright(F.col("at"), 33) == F.col("_task")) & F.col("at").between(F.col("_first"), F.col("_last"))
    met = lines.drop("part").join(F.broadcast(parts), here, "left")
    lost = F.when(F.col("_task").isNull(), F.raise_error(F.lit("the splits of the files changed between two scans"))).otherwise(F.col("_start"))
    own = ["_task", "_first", "_last", "_start", "_whole"]
    whole = met.where(F.coalesce("_whole", F.lit(True))).withColumn("line", lost + F.col("at") - F.col("_first")).drop(*own)
    if all(k[-1] for k in known):
        return whole
    gaps = met.where(~F.col("_whole")).withColumn("line", F.col("_start") + F.row_number().over(W.partitionBy("_first").orderBy("at")) - 1).drop(*own)
    return whole.unionByName(gaps)


def write_edge_list(graph: Graph, path: str) -> None:
    """The edge list of a graph as range-sorted files in the folder `path`: a header, then edges by source, in name order."""
    weight = ["weight"] if "weight" in graph.light.columns else []
    edges = graph.edges.select("src", "dst", *weight)
    header = graph.spark.range(1).select(F.lit(-1).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst"), *(F.lit(None).cast(edges.schema[w].dataType).alias(w) for w in weight))
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in edges.columns))  # made after the sort, which moves numbers only
    first = F.lit(f"{graph.n} {graph.edge_count()}")
    header.union(edges).orderBy("src", "dst").select(F.when(F.col("src") == -1, first).otherwise(line).alias("value")).write.text(path)
