"""Choosing, numbering and checking rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkscore.session import checkpoint_dir

SHOWN = 20  # offending rows named in an error message


def first_n(df: DataFrame, n: int = 32, key: str = "record") -> DataFrame:
    """The first ``n`` rows in ``key`` order."""
    return df.orderBy(key).limit(n)


def with_record(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order_by`` order as ``record``.

    The rows are range-partitioned and sorted, never gathered: a hash of the
    whole row breaks ties, so equal order values spread over partitions. The
    sorted rows are checkpointed, as the counts of the partitions and the rows
    must come from one and the same layout even when an executor is lost.
    """
    checkpoint_dir(df.sparkSession)
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    # Equal rows are told apart by their place, so they do not end in one partition.
    place = F.monotonically_increasing_id()
    laid_out = df.orderBy(*order_by, tie, place).checkpoint()
    placed = laid_out.select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_id"),
    )
    # One count per partition: as many rows as the sort has partitions.
    counts = placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, start = [], 0
    for row in counts:
        starts.append((row["_part"], start))
        start += row["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("record", F.col("_start") + within)
        .drop("_part", "_id", "_start")
    )


def pick_records(df: DataFrame, ids: Sequence[int], key: str = "record") -> DataFrame:
    """Rows of the listed records; ids that do not exist are skipped."""
    return df.where(F.col(key).isin([int(i) for i in ids]))


def missing_ids(df: DataFrame, ids: Sequence[int], key: str = "record") -> DataFrame:
    """The listed ids ``df`` has no row for."""
    wanted = df.sparkSession.createDataFrame([(int(i),) for i in ids], f"{key} bigint")
    found = df.where(F.col(key).isin([int(i) for i in ids])).select(key)
    return wanted.distinct().join(found, key, "left_anti")


def for_run(df: DataFrame, run_time: str | None = None) -> DataFrame:
    """Rows of one run, or all rows for None."""
    return df if run_time is None else df.where(F.col("run_time") == run_time)


def select_models(models: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows of the chosen models; an error when none is left."""
    chosen = models.where(F.col("model").isin(list(ids)))
    if chosen.limit(1).count() == 0:
        raise ValueError(f"no models selected: none of {list(ids)} is known")
    return chosen


def require_examples(
    df: DataFrame, columns: Sequence[str] = ("record", "completion", "width", "height")
) -> DataFrame:
    """``df`` itself, or an error when it is empty or lacks a column."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}; found {df.columns}")
    if df.limit(1).count() == 0:
        raise ValueError("no examples")
    return df


def example_error(completion: Column, width: Column, height: Column) -> Column:
    """Why an example cannot be used, NULL when it can."""
    return F.when(
        completion.isNull() | (completion == ""), "no completion"
    ).when(
        width.isNull() | height.isNull(), "image without width or height"
    )


def validate_examples(df: DataFrame) -> DataFrame:
    """Add ``error``; unusable examples stay as rows that carry their reason."""
    return df.withColumn(
        "error", example_error(F.col("completion"), F.col("width"), F.col("height"))
    )


def missing_targets(
    records: DataFrame, targets: DataFrame, key: str = "record", needs: Sequence[str] | None = None
) -> DataFrame:
    """Wanted records without a usable target.

    A target is usable if none of the columns ``needs`` is NULL, a blank text or
    false; left out, those are ``completion`` and ``has_render``, where present.
    """
    if needs is None:
        needs = [c for c in ("completion", "has_render") if c in targets.columns]
    usable = F.lit(True)
    kinds = dict(targets.dtypes)
    for name in needs:
        column = F.col(name)
        given = {"string": F.trim(column) != "", "boolean": column}.get(kinds[name], column.isNotNull())
        usable = usable & F.coalesce(given, F.lit(False))
    there = targets.where(usable).select(key)
    return records.select(key).distinct().join(there, key, "left_anti")


def require_targets(
    records: DataFrame, targets: DataFrame, key: str = "record", needs: Sequence[str] | None = None
) -> DataFrame:
    """``targets`` itself, or an error naming wanted records without a usable one."""
    missing = missing_targets(records, targets, key, needs)
    bad = [row[0] for row in missing.orderBy(key).take(SHOWN)]
    if bad:
        more = "" if len(bad) < SHOWN else f" ({len(bad)} of {missing.count()})"
        raise ValueError(f"records without a target: {bad}{more}")
    return targets


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error naming keys that stand more than once."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    bad = [tuple(row)[:-1] for row in counts.orderBy(*keys).take(SHOWN)]
    if bad:
        more = "" if len(bad) < SHOWN else f" ({len(bad)} of {counts.count()})"
        raise ValueError(f"more than one row for {list(keys)}: {bad}{more}")
    return df
