"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 20)))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node that each node of the edges (a, b) is connected to: (node, class_id).

    Each step points the larger neighbours of a node, then the node and its smaller neighbours, to the smallest of them; a large neighbourhood is the
    big side of a join with one row per node. Steps are written, so lineage stays short. Self loops are harmless.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    pairs = edges.groupBy("a").agg(F.min("b").alias("class_id"))
    return pairs.select(F.col("a").alias("node"), "class_id").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("class_id")).distinct())
