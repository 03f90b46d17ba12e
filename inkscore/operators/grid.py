"""Pairing candidates with targets and the complete models x records grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkscore.operators.bitmaps import coverage, holes
from inkscore.operators.skew import heavy_keys, pair_all, salted_join

METRICS = ("bleu", "structural", "pixel")


def pair_candidates(
    artifacts: DataFrame, examples: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """Candidates with the target of their record, inner join.

    A record may own a large part of the candidates (many models and runs), so
    the join is salted by model and run. ``hot`` may name the hot records
    (:func:`~inkscore.operators.skew.heavy_keys`), where a narrower table has them.
    """
    spread = [c for c in ("run_time", "model") if c in artifacts.columns]
    return salted_join(artifacts, examples, "record", spread, hot=hot)


def pair_bucketed(artifacts: DataFrame, examples: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """:func:`pair_candidates` of two tables in as many buckets by record: texts stay
    in their files.

    Candidates of hot records are left out of the join by bucket, where they would
    be one task, and meet their targets, few by the share that makes a record hot,
    wherever they are.
    """
    if hot is None:
        hot = heavy_keys(artifacts, "record")
    few = F.broadcast(hot.select("record"))
    rest = artifacts.join(few, "record", "left_anti").join(examples, "record")
    targets = F.broadcast(examples.join(few, "record", "left_semi"))
    crowd = artifacts.join(few, "record", "left_semi").join(targets, "record")
    return rest.unionByName(crowd)


def complete_grid(
    scores: DataFrame,
    groups: DataFrame,
    records: DataFrame,
    metrics: Sequence[str] = METRICS,
    flags: Sequence[str] = (),
) -> DataFrame:
    """One row per group (model, or run and model) and record.

    Missing scores become 0, missing ``flags`` false.
    """
    grid = pair_all(records.select("record"), groups)
    keys = [*groups.columns, "record"]
    filled = [F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in metrics]
    filled += [F.coalesce(F.col(f), F.lit(False)).alias(f) for f in flags]
    found = scores.select(*keys, *metrics, *flags)
    return grid.join(found, keys, "left").select(*keys, *filled)


def _files() -> dict[str, Column]:
    return {"markup": F.col("has_markup"), "render": F.col("has_render")}


def missing_artifacts(artifacts: DataFrame, groups: DataFrame, records: DataFrame) -> DataFrame:
    """``group, record, missing`` of every record of a group that lacks a file.

    Told from bitmaps of what is there, a few bytes for each 32,768 records, so
    the grid of groups and records is not built.
    """
    return holes(artifacts, groups, records.select("record"), _files())


def artifact_coverage(artifacts: DataFrame, groups: DataFrame, records: DataFrame) -> DataFrame:
    """``group, expected, markup, render, complete``: how many records have each file."""
    return coverage(artifacts, groups, records.select("record"), _files())
