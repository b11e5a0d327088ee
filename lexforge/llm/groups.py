"""Pairwise matches to groups, by Hash-to-Min on rows.

The cluster of a vertex is a set of rows (vertex, member) and never one value, so a
component of any size stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.session import cut


def star_links(rows: DataFrame, ids: Column) -> DataFrame:
    """Links a, b from the smallest id of each row's array to its other ids."""
    whole = rows.select(F.array_distinct(F.array_compact(ids)).alias("ids")).where("size(ids) > 1")
    first = F.array_min("ids")
    return whole.select(first.alias("a"), F.explode(F.array_remove("ids", first)).alias("b"))


def hash_to_min(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """group_id and node_id of every vertex of a link; group_id is the smallest vertex of its component.

    ``links`` has a and b; other columns are ignored. Links with a null end or from a
    vertex to itself are left out, repeated links count once. No links, no rows.

    In each round every vertex sends its members to the smallest of them, and that
    smallest to all members; smaller and smaller vertices take the clusters over until
    nothing changes, which takes a number of rounds that grows with the logarithm of
    the diameter. Minima are pre-aggregated before the shuffle, and a vertex that
    holds a large share of the rows is split by the adaptive skew join.
    """
    pairs = links.select(F.col("a").cast("string").alias("v"), F.col("b").cast("string").alias("u")).where("v is not null and u is not null and v <> u")
    ends = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
    clusters = cut(ends.unionByName(ends.select("v", F.col("v").alias("u"))).distinct())
    state = _state(clusters)
    for _ in range(most_rounds):
        low = clusters.groupBy("v").agg(F.min("u").alias("low"))
        seen = clusters.join(low, "v")
        sent = F.explode(F.array(F.struct(F.col("low").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("low").alias("u"))))
        clusters = cut(seen.select(sent.alias("x")).select("x.v", "x.u").distinct())
        before, state = state, _state(clusters)
        if state == before:
            return clusters.groupBy("v").agg(F.min("u").alias("low")).select(F.col("low").alias("group_id"), F.col("v").alias("node_id"))
    raise RuntimeError(f"not stable after {most_rounds} rounds")


def _state(clusters: DataFrame) -> tuple:
    """Row count and two order-free sums of hashes: equal only for equal sets."""
    return tuple(clusters.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("long"))).first())
