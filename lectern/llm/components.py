"""Connected components of a link table, by alternating large-star and
small-star steps. All of it stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, checkpointed


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v) with least: the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"), F.count(F.lit(1)).alias("n"))
    return attach(edges, least, ["u"], ["least"], "n", ["v"])


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links lead to) for every node of
    links (u, v: longs, either way round, repeats allowed).

    A large star links each larger neighbour of a node to the smallest one, a
    small star links the smaller ones and the node itself; both keep
    components, and the links end as stars about each smallest node. Rounds
    grow with the logarithm of the longest path. A node that a third of all
    links share is looked up by attach(), so no task gathers its links.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = checkpointed(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        large = _star(both(edges)).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        small = _star(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e")).select("e.*")
        edges = checkpointed(small.where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
