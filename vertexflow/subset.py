"""Sets of vertices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VertexSubset:
    """A set of ids within 0..n-1, as a DataFrame with the one column id. Immutable; repeated ids count once.

    The same type serves for queues and bitmaps: which physical form a join takes is left to the optimiser.
    """

    ids: DataFrame
    n: int
    known_size: int | None = None

    @classmethod
    def empty(cls, spark: SparkSession, n: int) -> VertexSubset:
        return cls(spark.range(0), n)

    @classmethod
    def universal(cls, spark: SparkSession, n: int) -> VertexSubset:
        return cls(spark.range(n), n)

    @classmethod
    def singleton(cls, spark: SparkSession, n: int, vertex: int) -> VertexSubset:
        if not 0 <= vertex < n:
            raise ValueError(f"vertex {vertex} is not in 0..{n - 1}")
        return cls(spark.range(vertex, vertex + 1), n, 1)

    @classmethod
    def of(cls, df: DataFrame, n: int, column: str = "id") -> VertexSubset:
        """The distinct non-null ids of a column; they must lie in 0..n-1 (see `check`)."""
        return cls(df.select(F.col(column).cast("long").alias("id")).where("id IS NOT NULL").distinct(), n)

    def check(self) -> VertexSubset:
        if not self.ids.where((F.col("id") < 0) | (F.col("id") >= self.n)).isEmpty():
            raise ValueError(f"ids outside 0..{self.n - 1}")
        return self

    def size(self) -> int:
        return self.ids.count()

    def capacity(self) -> int:
        return self.n

    def is_empty(self) -> bool:
        return self.ids.isEmpty()

    def clear(self) -> VertexSubset:
        return VertexSubset(self.ids.limit(0), self.n)

    def add(self, vertex: int) -> VertexSubset:
        return self | VertexSubset.singleton(self.ids.sparkSession, self.n, vertex)

    def remove(self, vertex: int) -> VertexSubset:
        return VertexSubset(self.ids.where(F.col("id") != vertex), self.n)

    def contains(self, vertex: int) -> bool:
        return not self.ids.where(F.col("id") == vertex).isEmpty()

    def __and__(self, other: VertexSubset) -> VertexSubset:
        return VertexSubset(self.ids.intersect(other.ids), max(self.n, other.n))

    def __or__(self, other: VertexSubset) -> VertexSubset:
        return VertexSubset(self.ids.union(other.ids).distinct(), max(self.n, other.n))

    def __xor__(self, other: VertexSubset) -> VertexSubset:
        """One aggregation: ids that occur on one side only."""
        sides = self.ids.withColumn("s", F.lit(1)).union(other.ids.withColumn("s", F.lit(2)))
        return VertexSubset(sides.groupBy("id").agg(F.bit_or("s").alias("s")).where("s <> 3").select("id"), max(self.n, other.n))

    def restrict(self, df: DataFrame, column: str = "id") -> DataFrame:
        """The rows of df whose column is in the set (semi join)."""
        return df.join(self.ids.withColumnRenamed("id", column), column, "left_semi")

    def flag(self, df: DataFrame, name: str, column: str = "id") -> DataFrame:
        """df with a boolean column that says whether its row is in the set (left join)."""
        marked = self.ids.select(F.col("id").alias(column), F.lit(True).alias(name))
        return df.join(marked, column, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
