"""Means, success and failure accounting, leaderboards.

Everything comes from one grouped aggregation with conditional aggregates, so a
model holding most of the rows is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkscore.functions.bands import BANDS, band, disagreement
from inkscore.functions.rounding import sig3, steady_parts, steady_sum, steady_total
from inkscore.operators.grid import METRICS
from inkscore.operators.rows import SHOWN

# The published column names and their order.
SUMMARY_COLUMNS = (
    "model",
    "count",
    "successful_count",
    "render_failures",
    "generation_failures",
    "bleu",
    "structural",
    "pixel",
    "bleu_successful",
    "structural_successful",
    "pixel_successful",
)


def is_failure() -> Column:
    """All three scores exactly 0."""
    return (F.col("bleu") == 0) & (F.col("structural") == 0) & (F.col("pixel") == 0)


def failure_type(has_markup: Column, has_render: Column) -> Column:
    """``render``: markup but no image; ``generation``: neither; else NULL."""
    markup, render = (F.coalesce(c, F.lit(False)) for c in (has_markup, has_render))
    return F.when(markup & ~render, "render").when(~markup & ~render, "generation")


def with_failure_type(df: DataFrame) -> DataFrame:
    return df.withColumn("failure", failure_type(F.col("has_markup"), F.col("has_render")))


def successful(scores: DataFrame) -> DataFrame:
    return scores.where(~is_failure())


def round_scores(scores: DataFrame) -> DataFrame:
    """Three significant figures per record, before anything is averaged."""
    return scores.withColumns({m: sig3(F.col(m)) for m in METRICS})


def _totals() -> list[Column]:
    """Sums and counts all means are made of. A failed row adds 0 to each sum,
    so the sums over all rows and over the successful rows are the same."""
    sums = [steady_sum(F.col(m)).alias(f"_{m}") for m in METRICS]
    good = F.count(F.when(~is_failure(), 1)).alias("successful_count")
    return [*sums, F.count("*").alias("count"), good]


def _means() -> dict[str, Column]:
    return {m: F.col(f"_{m}") / F.col("count") for m in METRICS}


def _successful_means(by: Sequence[str]) -> dict[str, Column]:
    """Means over the successful rows, and their number. Groups without any hold
    NULL where another group of the same run succeeded, 0 where none did."""
    run = [c for c in by if c != "model"]
    wins = F.sum("successful_count").over(Window.partitionBy(*run))
    count = F.when((F.col("successful_count") > 0) | (wins == 0), F.col("successful_count"))

    def mean(metric: str) -> Column:
        share = F.col(f"_{metric}") / F.nullif(F.col("successful_count"), F.lit(0))
        return F.when(wins == 0, 0.0).otherwise(share)

    return {**{f"{m}_successful": mean(m) for m in METRICS}, "successful_count": count}


def _failures() -> list[Column]:
    kind = failure_type(F.col("has_markup"), F.col("has_render"))
    return [
        F.count(F.when(kind == name, 1)).alias(f"{name}_failures")
        for name in ("render", "generation")
    ]


def _select(df: DataFrame, by: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    return df.select(*by, *[column.alias(name) for name, column in columns.items()])


def mean_scores(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    totals = scores.groupBy(*by).agg(*_totals())
    return _select(totals, by, {**_means(), "count": F.col("count")})


def successful_means(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return _select(scores.groupBy(*by).agg(*_totals()), by, _successful_means(by))


def failure_counts(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return df.groupBy(*by).agg(*_failures())


def failure_totals(df: DataFrame) -> DataFrame:
    """``failure, count`` over all rows, both types always present."""
    return df.agg(*_failures()).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("failure"), F.col(f"{n}_failures").alias("count"))
                    for n in ("render", "generation")
                ]
            )
        )
    )


def success_rate(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    good = F.count(F.when(~is_failure(), 1))
    return scores.groupBy(*by).agg(
        good.alias("successful_count"),
        F.count("*").alias("count"),
        (good * 100 / F.count("*")).alias("success_percent"),
    )


def incomplete_models(scores: DataFrame, n: int, by: Sequence[str] = ("model",)) -> DataFrame:
    """Groups that do not have exactly ``n`` rows."""
    return scores.groupBy(*by).agg(F.count("*").alias("count")).where(F.col("count") != n)


def check_complete(
    scores: DataFrame, n: int, by: Sequence[str] = ("model",), groups: int | None = None
) -> DataFrame:
    """``scores`` itself, or an error naming groups with more or fewer rows.

    With ``groups``, their number is checked too: a model without any row has no
    group of its own that could be found wanting.
    """
    wrong = incomplete_models(scores, n, by)
    bad = [tuple(row) for row in wrong.take(SHOWN)]
    if bad:
        raise ValueError(f"expected {n} records per group but found {named(bad, wrong)}")
    if groups is not None:
        there = scores.select(*by).distinct().count()
        if there != groups:
            raise ValueError(f"expected {groups} groups of {n} records but found {there}")
    return scores


def named(shown: list, all_of: DataFrame) -> str:
    """The offenders shown, and how many there are if those are not all."""
    more = "" if len(shown) < SHOWN else f" ({len(shown)} of {all_of.count()})"
    return f"{shown}{more}"


def summarize(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The summary table of ``scores`` rows that carry ``has_markup, has_render``.

    Scores are taken as already rounded per record; the means are rounded again.
    """
    return _summary_of(scores.groupBy(*by).agg(*_totals(), *_failures()), by)


def _summary_of(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    columns = {c: F.col(c) for c in SUMMARY_COLUMNS} | _means() | _successful_means(by)
    for name in columns:
        if name.removesuffix("_successful") in METRICS:
            columns[name] = sig3(columns[name])
    lead = [c for c in by if c != "model"]
    return _select(totals, lead, {c: columns[c] for c in SUMMARY_COLUMNS})


COUNTS = ("count", "successful_count", "render_failures", "generation_failures")


def summary_state(scores: DataFrame, by: Sequence[str] = ("run_time", "model")) -> DataFrame:
    """What a summary is made of, in a form that can be added to: ``by``, counts, and
    for each metric its exact sum in whole units and the rest below them."""
    sums = []
    for metric in METRICS:
        units, rest = steady_parts(F.col(metric))
        sums += [units.alias(f"{metric}_units"), rest.alias(f"{metric}_rest")]
    return scores.groupBy(*by).agg(*sums, *_totals()[len(METRICS) :], *_failures())


def merge_states(states: DataFrame, by: Sequence[str] = ("run_time", "model")) -> DataFrame:
    """Rows of several states (a union), or of one by fewer columns, added up."""
    sums = [F.sum(f"{m}_units").cast("decimal(38,0)").alias(f"{m}_units") for m in METRICS]
    rests = [F.sum(f"{m}_rest").alias(f"{m}_rest") for m in METRICS]
    return states.groupBy(*by).agg(*sums, *rests, *[F.sum(c).alias(c) for c in COUNTS])


def summary_of_state(state: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """What :func:`summarize` gives for the rows that the state was made of."""
    merged = merge_states(state, by)
    totals = [steady_total(F.col(f"{m}_units"), F.col(f"{m}_rest")).alias(f"_{m}") for m in METRICS]
    return _summary_of(merged.select(*by, *totals, *COUNTS), by)


def leaderboard(summary: DataFrame, metric: str = "bleu") -> DataFrame:
    """Models by their mean over successful rows, best first, ties by name.

    Columns before ``model``, as the run of a summary by run, stay in front and
    every run is ranked on its own.
    """
    lead = summary.columns[: summary.columns.index("model")]
    score = f"{metric}_successful"
    return summary.select(*lead, "model", score, "successful_count").orderBy(
        *lead, F.desc_nulls_last(score), "model"
    )


def score_bands(scores: DataFrame) -> DataFrame:
    return scores.withColumns({f"{m}_band": band(F.col(m), m) for m in BANDS})


def with_disagreement(scores: DataFrame) -> DataFrame:
    return scores.withColumn(
        "disagreement", disagreement(*[F.col(m) for m in METRICS])
    )
