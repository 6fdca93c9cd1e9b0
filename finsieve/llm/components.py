"""Connected components of large graphs by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_path, stored_at

MOST_ROUNDS = 60
#: Rows of a file of a round's edges.
FILE_ROWS = 1 << 16


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("b > a").join(_least(both), "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    joined = edges.join(_least(edges), "a")
    tied = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.unionByName(joined.select("a", F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node that has an edge: the smallest node that it is linked with, itself included.

    edges: long columns a and b, in any order and number; loops and nulls are left out. Minima are
    taken by partial aggregation and joined back, so that a node of very many links is split by AQE
    and never held by one task. Each round's edges go to the shared folder, in as few files as their
    number asks for, and the round's before are deleted; only two numbers of a round come to the
    driver. An empty table gives no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    spark, path, before = edges.sparkSession, shared_path(edges.sparkSession, "links"), None
    edges = stored_at(edges, path)
    for _ in range(MOST_ROUNDS):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
        done, path = path, shared_path(spark, "links")
        edges = stored_at(_small_star(_large_star(edges).distinct()).distinct().coalesce(-(-now[0] // FILE_ROWS)), path)
        discard(spark, done)
    raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
