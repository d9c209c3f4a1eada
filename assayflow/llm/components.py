"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayflow.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex points its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours point to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is the larger end of none."""
    ends = edges.select(F.col("a").alias("v"), "b").union(edges.select("b", F.lit(None).cast("long")))
    seen = ends.groupBy("v").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("b").alias("up"), F.count(F.lit(1)).alias("n"))
    return not seen.filter("low < high or (up > 0 and up < n)").agg(F.count(F.lit(1)).alias("n")).first().n


def stars(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """``a, b`` for every vertex ``a`` of ``edges(a, b)``, both longs, that is not its component's least vertex ``b``.

    Alternates large and small stars until the table is one of stars: O(log n) rounds in practice, each
    round a few shuffles of the edges, whose number never grows. Both minima combine before the shuffle,
    and the joins on a hot centre have one row on the other side, so AQE may split them.
    """
    found, i = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"), 0
    while not _settled(found):
        i += 1
        found = scratch.save(_small_star(_large_star(found)).distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
    return found


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """``vertex, root`` for every vertex of ``edges(a, b)``, both longs; a root is its component's least vertex."""
    found = stars(edges, scratch, name)
    return found.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(found.select("b", "b").distinct())
