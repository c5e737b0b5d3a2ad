"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from passagework.llm.base import written


def _large_stars(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on its smallest one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_stars(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of them; edges point from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long) that is not the smallest of its component.

    Both star steps (Kiveris et al., 2014) shuffle edges and per-node minima only and never gather a node's
    neighbours; a logarithmic number of rounds ends in stars. Each round is written before the next reads it.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = written(edges.select(larger, smaller).filter("a <> b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = written(_small_stars(_large_stars(now)), "stars")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
