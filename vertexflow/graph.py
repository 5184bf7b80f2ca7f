"""Directed property multigraphs as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .barrier import planned_with

OUT_DEGREE = "outdeg"


#: A source with more edges than this, and than a quarter of a partition's share, is a hub.
HUB_EDGES = 100_000


def _hubs(edges: DataFrame, many: int, hub_edges: int) -> tuple[int, DataFrame | None]:
    """The number of edges and (src, outdeg) of the hubs, None without any.

    Edges are counted by buckets of sources first, which hardly need a shuffle; only sources of buckets with as many edges as a hub are counted one by one.
    """
    bucket = F.pmod(F.xxhash64("src"), F.lit(64 * many))
    counts = edges.groupBy(bucket.alias("bucket")).agg(F.count("*").alias(OUT_DEGREE)).persist()
    try:
        m = counts.agg(F.sum(OUT_DEGREE)).first()[0] or 0
        least = max(hub_edges, m // (4 * many))
        hot = [r["bucket"] for r in counts.where(F.col(OUT_DEGREE) > least).collect()]  # fewer than m / least rows: 4 per partition at most
    finally:
        counts.unpersist()
    if not hot:
        return m, None
    degree = edges.where(bucket.isin(hot)).groupBy("src").agg(F.count("*").alias(OUT_DEGREE))
    hubs = degree.where(F.col(OUT_DEGREE) > least)
    rows = hubs.collect()
    return m, edges.sparkSession.createDataFrame(rows, hubs.schema) if rows else None


@dataclass(frozen=True)
class Graph:
    """vertices: id in 0..n-1 and state columns. Edges: src, dst, attributes and the out-degree of src.

    Loops and parallel edges stay and count. Vertices without edges exist: the vertex set is the range, not the ends.
    Edges lie dealt and sorted by src, those of hubs apart and dealt by both ends; hubs are at most 4 per partition.
    """

    vertices: DataFrame
    light: DataFrame
    n: int
    heavy: DataFrame | None = None
    hubs: DataFrame | None = None
    m: int | None = None

    @classmethod
    def of(cls, edges: DataFrame, n: int, partitions: int | None = None, cache: bool = True, hub_edges: int = HUB_EDGES, stage: bool = True) -> Graph:
        """Edges (src, dst, attributes...) are computed and dealt once and kept; each superstep joins them where they lie.

        stage=False: the caller keeps the edges already, so that reading them twice computes nothing again.
        """
        spark = edges.sparkSession
        many = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        keep = (lambda df: df.persist()) if cache else (lambda df: df)
        edges = edges.where("src IS NOT NULL")
        staged = keep(edges) if stage else edges
        m, hubs = _hubs(staged, many, hub_edges)
        heavy = None
        rest = staged
        if hubs is not None:
            rest = staged.join(F.broadcast(hubs.select("src")), "src", "left_anti")
            heavy = keep(staged.join(F.broadcast(hubs), "src").repartition(many, "src", "dst"))
        # one sort deals the edges, counts those of a source and stays as their order
        light = keep(rest.repartition(many, "src").withColumn(OUT_DEGREE, F.count("*").over(W.partitionBy("src"))).sortWithinPartitions("src"))
        if cache:
            for part in (light, heavy) if heavy is not None else (light,):
                part.count()  # computed while the staged edges are there
            if stage:
                staged.unpersist()
        return cls(spark.range(n), light, n, heavy, hubs, m)

    @property
    def edges(self) -> DataFrame:
        return self.light if self.heavy is None else self.light.unionByName(self.heavy)

    def with_edges(self, change) -> Graph:
        """The graph with change(edges) for each part of its edges; src and the out-degree must stay."""
        return replace(self, light=change(self.light), heavy=None if self.heavy is None else change(self.heavy))

    @property
    def spark(self) -> SparkSession:
        return self.light.sparkSession

    def with_vertices(self, vertices: DataFrame) -> Graph:
        return replace(self, vertices=vertices)

    def with_state(self, **columns: Column) -> Graph:
        """State columns for all vertices, dealt by id so that messages meet them without moving them again."""
        many = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.with_vertices(self.vertices.select("id", *(c.alias(k) for k, c in columns.items())).repartition(many, "id"))

    def vertex_count(self) -> int:
        return self.n

    def edge_count(self) -> int:
        return self.edges.count() if self.m is None else self.m

    def validate(self) -> Graph:
        """Raises where an end of an edge is null or outside 0..n-1."""
        bad = self.edges.where(~(F.col("src").between(0, self.n - 1) & F.col("dst").between(0, self.n - 1)) | F.col("src").isNull() | F.col("dst").isNull())
        found = bad.select("src", "dst").head(1)
        if found:
            raise ValueError(f"edge {found[0][0]} -> {found[0][1]} leaves 0..{self.n - 1}")
        return self

    def out_degrees(self) -> DataFrame:
        """(id, outdeg) of all vertices."""
        degree = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias(OUT_DEGREE))
        return self.vertices.select("id").join(degree, "id", "left").select("id", F.coalesce(OUT_DEGREE, F.lit(0)).cast("long").alias(OUT_DEGREE))

    def degree_histogram(self) -> DataFrame:
        """(slot, vertices, percent) for slots 0..max: slot 0 has degree 0, slot k the degrees 2^(k-1) .. 2^k - 1."""
        slot = F.when(F.col(OUT_DEGREE) == 0, 0).otherwise(F.length(F.bin(OUT_DEGREE))).cast("int")
        counts = self.out_degrees().groupBy(slot.alias("slot")).agg(F.count("*").alias("vertices"))
        slots = counts.agg(F.max("slot").alias("m")).where("m IS NOT NULL").select(F.explode(F.sequence(F.lit(0), "m")).alias("slot"))
        filled = slots.join(counts, "slot", "left").withColumn("vertices", F.coalesce("vertices", F.lit(0)))
        return filled.select("slot", "vertices", (100.0 * F.col("vertices") / self.n).alias("percent"))

    def adjacency(self, base: int = 0) -> DataFrame:
        """(id, neighbours): the sorted out-neighbours of all vertices, parallel edges repeated, base added. For inspection: rows as long as degrees."""
        lists = self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.col("dst") + base)).alias("neighbours"))
        nothing = F.array().cast("array<bigint>")
        return self.vertices.select("id").join(lists, "id", "left").select("id", F.coalesce("neighbours", nothing).alias("neighbours"))

    def write_in_order(self, rows: DataFrame, path: str) -> None:
        """Writes `value` of rows, one a vertex, as files by ranges of ids, in name order; ids below 0 come first.

        The bounds are known, so nothing is computed for a sample; lists are collected along the order of the edges, without a table of all keys.
        """
        many = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        width = max(1, -(-self.n // many))
        block = F.floor(F.greatest("id", F.lit(0)) / width).cast("int")
        with planned_with(self.spark, "spark.sql.execution.useObjectHashAggregateExec", "false"):
            rows.repartitionById(many, block).sortWithinPartitions("id").select("value").write.text(path)

    def release(self) -> None:
        self.light.unpersist()
        if self.heavy is not None:
            self.heavy.unpersist()
