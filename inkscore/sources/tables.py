"""Tables: examples, raw responses, artifacts, scores, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkscore.operators.grid import METRICS
from inkscore.operators.rows import for_run
from inkscore.operators.summary import COUNTS, summary_state

SCORE_SCHEMA = "record BIGINT, model STRING, bleu DOUBLE, structural DOUBLE, pixel DOUBLE"
SUMMARY_SCHEMA = (
    "model STRING, count BIGINT, successful_count BIGINT, render_failures BIGINT, "
    "generation_failures BIGINT, bleu DOUBLE, structural DOUBLE, pixel DOUBLE, "
    "bleu_successful DOUBLE, structural_successful DOUBLE, pixel_successful DOUBLE"
)
RAW_SCHEMA = "record BIGINT, model STRING, response STRING, error STRING, run_time STRING"
LOG_SCHEMA = "record BIGINT, model STRING, response STRING, run_time STRING"
_EXAMPLE_TYPES = {"record": "bigint", "completion": "string", "width": "int", "height": "int"}


def read_examples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Evaluation examples; ``split`` prunes the partitions of that name."""
    df = spark.read.parquet(path)
    absent = [c for c in _EXAMPLE_TYPES if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}; found {df.columns}")
    if split is not None:
        df = df.where(F.col("split") == split)
    typed = {c: F.col(c).cast(t) for c, t in _EXAMPLE_TYPES.items()}
    return df.withColumns(typed)


def append_raw(df: DataFrame, path: str, run_time: str) -> None:
    """Append one run's responses to the log, stamped with its run time."""
    stamped = df.select("record", "model", "response", "error", F.lit(run_time).alias("run_time"))
    stamped.write.mode("append").partitionBy("run_time").parquet(path)


def read_raw(spark: SparkSession, path: str, run_time: str | None = None) -> DataFrame:
    """Responses of one run (only its partition is read) or of all runs."""
    return for_run(spark.read.schema(RAW_SCHEMA).parquet(path), run_time)


def read_raw_csv(spark: SparkSession, path: str, run_time: str | None = None) -> DataFrame:
    """A CSV response log with quoted newlines and doubled quotes."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    return for_run(spark.read.schema(LOG_SCHEMA).options(**options).csv(path), run_time)


def write_artifacts(df: DataFrame, path: str) -> None:
    """Markup and flags per run, model and record, one folder per run and model.

    Writing a run and model again replaces its folder and leaves the others. The
    rows are rebalanced by run and model: one that holds most of the rows is
    split over as many tasks as its size asks for.
    """
    laid_out = df.hint("rebalance", F.col("run_time"), F.col("model"))
    writer = laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_time", "model").parquet(path)


def read_artifacts(spark: SparkSession, path: str, run_time: str | None = None) -> DataFrame:
    schema = T.StructType.fromDDL(
        "record BIGINT, markup STRING, has_markup BOOLEAN, has_render BOOLEAN, response STRING, "
        "run_time STRING, model STRING"
    )
    return for_run(spark.read.schema(schema).parquet(path), run_time)


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _read_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A CSV table of these columns, with a leading ``run_time`` where its header has one.

    The header decides, and a header that names other columns raises.
    """
    options = {"header": True, "enforceSchema": False}
    found = spark.read.option("header", True).csv(path).columns
    lead = "run_time STRING, " if "run_time" in found else ""
    schema = T.StructType.fromDDL(lead + columns)
    if found and found != schema.names:
        raise ValueError(f"columns {found} in {path}; expected {schema.names}")
    return spark.read.schema(schema).options(**options).csv(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Per-record scores as CSV with a header, in model and record order."""
    lead = [c for c in ("run_time",) if c in df.columns]
    ordered = df.select(*lead, "record", "model", "bleu", "structural", "pixel")
    _write_csv(ordered.orderBy(*lead, "model", "record"), path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, SCORE_SCHEMA)


def write_summary(df: DataFrame, path: str) -> None:
    """The summary as CSV with a header, one row per model, or per run and model."""
    lead = [c for c in ("run_time",) if c in df.columns]
    _write_csv(df.orderBy(*lead, "model"), path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, SUMMARY_SCHEMA)


def append_raw_csv(df: DataFrame, path: str, run_time: str) -> None:
    """Append one run's responses to a CSV log; an error stands in for its response."""
    response = F.coalesce("response", "error").alias("response")
    stamped = df.select("record", "model", response, F.lit(run_time).alias("run_time"))
    options = {"header": True, "quote": '"', "escape": '"'}
    stamped.write.mode("append").options(**options).csv(path)


def update_summary_state(scores: DataFrame, path: str) -> None:
    """Puts the runs of ``scores`` into the kept state, reading nothing else.

    A run is a folder of its own: a run that is put in again replaces what it was, and
    the others stay as they are.
    """
    writer = summary_state(scores).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_time").parquet(path)


def read_summary_state(spark: SparkSession, path: str) -> DataFrame:
    sums = ", ".join(f"{m}_units DECIMAL(38,0), {m}_rest DOUBLE" for m in METRICS)
    counts = ", ".join(f"{c} BIGINT" for c in COUNTS)
    return spark.read.schema(f"model STRING, {sums}, {counts}, run_time STRING").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "record") -> DataFrame:
    """``df`` as the table ``table`` under ``path``, in files by hash of ``key`` and sorted
    by it; returns it read back. Tables of as many buckets meet without a shuffle."""
    laid_out = df.repartition(buckets, key).sortWithinPartitions(key)
    writer = laid_out.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
