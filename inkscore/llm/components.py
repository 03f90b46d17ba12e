"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, settle


def _least_of_each(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("hi").agg(F.min("lo").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """The smallest node each node is linked to, directly or not: node, label.

    ``links`` has two columns of one comparable type; nodes without a link, and
    the smallest of each component, are not in the result. Alternates the
    large-star and small-star steps, which need a number of rounds logarithmic
    in the nodes; a node's neighbours are only ever reduced to their minimum, so
    no task holds the neighbourhood of a node.
    """
    a, b = (F.col(c) for c in links.columns)
    pairs = links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    pairs = settle(pairs.distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())

    seen = mark(pairs)
    while seen[0]:
        # Large star: each node's larger neighbours move to its smallest one.
        both = pairs.union(pairs.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m"))
        least = least.select(F.col("hi").alias("node"), F.least("hi", "m").alias("least"))
        large = (
            pairs.join(least, F.col("lo") == F.col("node"))
            .select("hi", F.col("least").alias("lo"))
            .distinct()
        )
        # Small star: each node and its smaller neighbours move to the smallest.
        joined = large.join(_least_of_each(large), "hi")
        moved = joined.where(F.col("lo") != F.col("least")).select(
            F.col("lo").alias("hi"), F.col("least").alias("lo")
        )
        kept = joined.select("hi", F.col("least").alias("lo"))
        before, pairs = pairs, settle(moved.union(kept).distinct(), "links")
        free(before)
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
