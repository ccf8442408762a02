"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, name: str) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b`` long); root is the least node reachable.

    Each round sends every neighbour to the least one around it, first the larger neighbours, then
    the smaller ones, so paths shrink by half or more. A round is two aggregations that combine on
    the map side and a join, written to the shared folder; only a count and a checksum reach the
    driver. Loops and repeated links are harmless.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, f"{name}-links")
    before = _state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct(), f"{name}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-small")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
