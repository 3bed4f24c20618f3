"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(``node``, ``component``) for every node of ``edges`` (``a``, ``b``); the component is its smallest node.

    Each step finds the smallest neighbour of a node by an aggregation with map-side combine and joins it back, so no
    node's neighbours meet in one row or group; Spark splits a hub in the join. Edges are kept distinct. Steps go on
    until no edge changes: O(log^2 n) of them at most, few in practice. Each step's edges are a table in the shared
    folder, which ends the lineage; the table and shuffle files of the step before go. Edges with a null end and loops are left out; no edges give no rows.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = written(pairs, "edges")  # u > v: every edge points to the smaller node
    before = None
    for _ in range(rounds):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        # large-star: of each node u, the larger neighbours go to the smallest of u and its neighbours
        large = pairs.join(least, F.col("v") == F.col("n")).select(F.col("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: a node and its smaller neighbours go to the smallest of these
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, pairs = pairs, written(small, "edges")
        dropped(last)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v"), F.col("v")).distinct())
