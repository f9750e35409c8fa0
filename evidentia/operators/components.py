"""Connected components by alternating star contractions, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidentia.session import forget, tables, written

#: Neighbours from which on a node may be a hub, and hubs that all tasks are told at most.
HUB, HUBS = 256, 50_000


def _with_least(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """The edges (u, v) with m of their u. `least` has u, m and n, the number of edges that it was made of.

    The edges of a hub, a node of more than `most` edges, never meet: its m is told to all tasks.
    `most` bounds the number of hubs by HUBS.
    """
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", "m"))
    others = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return edges.join(hubs, "u").select("u", "v", "m").unionByName(others.select("u", "v", "m"))


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Hang every larger neighbour of a node on the least node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("v > u"), least, most).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them; edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hung = _with_least(edges, least, most).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    Large-star and small-star steps alternate until the edges no longer change; the number of
    rounds grows with the logarithm of the diameter. Minima are combined before each shuffle, and
    the edges of hubs, of which there are HUBS at most, are joined without one. Self-loops and
    nulls are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    before = tables()
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen, old = mark, tables() - before
        most = max(HUB, 4 * mark[0] // HUBS)  # each step has two edges for each of these at most
        now = written(_small_star(written(_large_star(now, most)), most))
        forget(spark, old)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
