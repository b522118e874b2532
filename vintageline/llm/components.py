"""Connected components of a link table, by alternating star operations on DataFrames.

A round hangs the larger neighbours of every node under its smallest one, then ties the smaller ones
together. Rounds repeat until the links stop changing, which takes about the logarithm of the longest
chain. Minima are combined before they are shuffled, links of one node stay separate rows, and each
round is written to the shared folder, so neither a hot node nor a lost executor sets the work back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintageline.llm.common import materialize


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def _star_round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links with a > b."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.distinct()
    under = large.groupBy("a").agg(F.min("b").alias("m"))
    tied = large.join(under, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return under.select("a", F.col("m").alias("b")).union(tied).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every linked node that is not itself the smallest.

    ``links`` has long columns a and b in any order; null ends and loops are left out.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = materialize(ordered.distinct(), "links")
    before = _signature(current)
    while True:
        current = materialize(_star_round(current), "links")
        after = _signature(current)
        if after == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
