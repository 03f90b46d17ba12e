"""Joins that hold when one key owns a large part of the rows, and pairing of
every row with a short table without a cross join. Nothing here runs a job while
a plan is built: what is hot is found out by the plan itself."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot when it holds more than this share of the rows, or more than one
# shuffle partition's share where there are more partitions, and more than LEAST rows.
HOT_SHARE = 0.001
LEAST = 100_000
# Sketches that one task merges: those of the partitions are first merged in so many groups.
GROUPS = 256
# Fixed values of the sketch: a count errs by at most 3.5 / counters of all rows, and
# the largest number of counters.
ERROR, MOST_COUNTERS = 3.5, 1_000_000
COMPLEX = (T.ArrayType, T.MapType, T.StructType)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def frequent_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """``key, total`` of every key with more than ``share`` of the rows, and few others.

    One pass over the key column: each task keeps a sketch of bounded counters
    (frequent items), and sketches are merged in two steps. At most 2 / ``share``
    rows, as the sketch errs by less than half of ``share``. NULL is no key.
    """
    counters = min(MOST_COUNTERS, math.ceil(2.1 * ERROR / share))
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("_group")
    keys = df.select(F.col(key).alias("_key"), group).where(F.col("_key").isNotNull())
    states = keys.groupBy("_group").agg(
        F.expr(f"approx_top_k_accumulate(_key, {counters})").alias("_state"), F.count("*").alias("_n")
    )
    merged = states.agg(
        F.expr(f"approx_top_k_combine(_state, {counters})").alias("_state"), F.sum("_n").alias("total")
    )
    rows = min(counters, math.ceil(2 / share))
    found = merged.where(F.col("total") > 0).select(
        "total", F.inline(F.expr(f"approx_top_k_estimate(_state, {rows})")).alias(key, "_about")
    )
    # Estimates are not below the count.
    return found.where(F.col("_about") > F.col("total") * share).select(key, "total")


def heavy_keys(
    df: DataFrame, key: str, share: float | None = None, least: int = LEAST
) -> DataFrame:
    """``key, n, salts`` of the keys with more than ``share`` of all rows and more
    than ``least`` rows: their exact count, and the number of tasks their rows fill.

    The keys that the sketch names are counted anew, which combines before it moves.
    ``salts`` follows from the count alone: an even share of the rows per shuffle
    partition. At most 1 / ``share`` rows.
    """
    partitions = _partitions(df)
    if share is None:
        share = min(HOT_SHARE, 1 / partitions)
    likely = frequent_keys(df, key, share)
    counted = (
        df.select(key)
        .join(F.broadcast(likely), key)
        .groupBy(key, "total")
        .agg(F.count("*").alias("n"))
        .where((F.col("n") > least) & (F.col("n") > F.col("total") * share))
    )
    salts = F.ceil(F.col("n") * partitions / F.col("total"))
    return counted.select(key, "n", F.greatest(salts, F.lit(2)).cast("int").alias("salts"))


def salted_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    spread: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi join of ``many`` with ``one`` (unique by ``key``).

    Rows of a hot key are spread over as many buckets as its count asks for, by the
    ``spread`` columns, and only the ``one`` rows of hot keys are repeated to
    meet them. ``hot`` is a table as of :func:`heavy_keys`, whose rows are few by the
    share they stand for; left out, it is found in ``many``. ``how`` is inner or
    left; the result is that of the plain join.
    """
    if hot is None:
        hot = heavy_keys(many, key)
    salts = F.broadcast(hot.select(key, F.col("salts").alias("_salts")))
    bucket = F.pmod(F.xxhash64(*spread), F.col("_salts"))
    left = many.join(salts, key, "left").withColumn("_salt", F.coalesce(bucket, F.lit(0)).cast("int"))
    buckets = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = one.join(salts, key, "left").withColumn("_salt", F.explode(buckets))
    joined = left.drop("_salts").join(right.drop("_salts"), [key, "_salt"], how)
    return joined.drop("_salt")


def pair_all(left: DataFrame, right: DataFrame, salts: int | None = None) -> DataFrame:
    """Every row of ``left`` with every row of the short table ``right``.

    An equi join on a salt: ``left`` is spread over the salts (twice the shuffle
    partitions, unless given) and ``right`` repeated under each. The same plan for
    any size: where Spark knows ``right`` to be small it broadcasts it and
    ``left`` does not move, else neither side lands in one task.
    """
    if salts is None:
        salts = 2 * _partitions(left)
    plain = [f.name for f in left.schema if not isinstance(f.dataType, COMPLEX)]
    bucket = F.pmod(F.xxhash64(*plain), F.lit(salts)) if plain else F.lit(0)
    many = left.withColumn("_salt", bucket.cast("int"))
    few = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.join(few, "_salt").drop("_salt")
