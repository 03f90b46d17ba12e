"""A log of responses that a broken run can go on with.

A run writes its answers in parts. Each part is staged in a folder that readers do
not see and then renamed into the log, so the log holds whole parts only; a run
that is repeated asks for the answers that no committed part holds. Renaming a
folder is one step on HDFS and local disks; on a store where it is not, a
committer of that store has to take its place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscore.operators.rows import for_run

SCHEMA = "record BIGINT, model STRING, response STRING, error STRING, run_time STRING, part STRING"
KEYS = ("run_time", "model", "record")
PARTS = 16
STAGING = "_staging"  # readers pass over names that begin so


def _paths(spark: SparkSession, *paths: str):
    jvm = spark._jvm
    made = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return made[0].getFileSystem(spark._jsc.hadoopConfiguration()), *made


def read_ledger(spark: SparkSession, path: str, run_time: str | None = None) -> DataFrame:
    """``record, model, response, error, run_time`` of all committed parts, or of one run's."""
    files, root = _paths(spark, path)
    if not files.exists(root) or not any(s.isDirectory() and s.getPath().getName()[0] not in "_." for s in files.listStatus(root)):
        return spark.createDataFrame([], SCHEMA).drop("part")
    return for_run(spark.read.schema(SCHEMA).parquet(path), run_time).drop("part")


def pending(prompts: DataFrame, path: str, run_time: str) -> DataFrame:
    """The ``model, record`` rows of ``prompts`` without a committed answer in the run."""
    done = read_ledger(prompts.sparkSession, path, run_time).select("model", "record")
    return prompts.join(done, ["model", "record"], "left_anti").select(*prompts.columns)


def commit_part(answers: DataFrame, path: str, run_time: str) -> str:
    """Writes one part of a run and makes it visible at once; its name."""
    spark, name = answers.sparkSession, uuid.uuid4().hex
    staged, final = f"{path}/{STAGING}/{name}", f"{path}/run_time={run_time}/part={name}"
    answers.select("record", "model", "response", "error").write.parquet(staged)
    files, source, target = _paths(spark, staged, final)
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"could not commit {staged}")
    return name


def record_responses(
    prompts: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    path: str,
    run_time: str,
    parts: int = PARTS,
) -> int:
    """Asks ``answer`` for what the run lacks and commits it, part by part; the number
    of parts that were committed.

    ``prompts`` has one row for each ``record, model``; ``answer`` turns some of its
    rows into ``record, model, response, error`` (as
    :func:`inkscore.operators.infer.infer` does). Parts are dealt by a hash of model
    and record, so they are the same in every attempt and a part is asked for only
    if it has open rows. An attempt that breaks loses at most the part it was at; repeating
    it gives each key once. One attempt of a run may write at a time. What
    broken attempts left in the staging folder is removed.
    """
    spark = prompts.sparkSession
    files, staging = _paths(spark, f"{path}/{STAGING}")
    files.delete(staging, True)
    part = F.pmod(F.xxhash64("model", "record"), F.lit(parts))
    open_parts = pending(prompts, path, run_time).groupBy(part.alias("p")).count().orderBy("p").collect()
    for row in open_parts:
        own = pending(prompts.where(part == row["p"]), path, run_time)
        commit_part(answer(own), path, run_time)
    files.delete(staging, True)
    return len(open_parts)
