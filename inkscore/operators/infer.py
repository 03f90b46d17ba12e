"""Distributed calls of a user's generator, with errors kept per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscore.functions.markup import extract_markup

RAW_SCHEMA = "record BIGINT, model STRING, response STRING, error STRING"


def infer(
    prompts: DataFrame,
    fn: Callable[..., str] | Mapping[str, Callable[..., str]],
    setup: Callable[[], Any] | None = None,
    parallel: int | Mapping[str, int] | None = None,
) -> DataFrame:
    """Call ``fn`` for every ``record, model, prompt`` row.

    ``fn`` and ``parallel`` may each be given by model; a model without a function
    gets error rows, one without a number keeps its partitions.

    ``fn(row)`` gets the row as a dict; with ``setup``, ``fn(row, instance)``
    also gets what ``setup()`` returned, made once per task. At most ``parallel``
    calls run at a time (1 = one after another); None keeps the partitions as
    they are. A row that already carries an ``error`` is not sent. An exception,
    or an answer that is neither text nor None, becomes the ``error`` of its row;
    other rows go on.
    """
    if isinstance(parallel, Mapping):
        model = F.col("model")
        rest = prompts.where(~F.coalesce(model.isin(list(parallel)), F.lit(False)))
        answers = infer(rest, fn, setup)
        for name, count in parallel.items():
            answers = answers.unionByName(infer(prompts.where(model == name), fn, setup, count))
        return answers
    if parallel:
        prompts = prompts.repartition(parallel, "record", "model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: list[Any] = []
        for batch in batches:
            answers = [_call(row, fn, setup, ready) for row in batch.to_dict("records")]
            yield pd.DataFrame(answers, columns=["record", "model", "response", "error"])

    return prompts.mapInPandas(run, RAW_SCHEMA)


def _call(row: dict, fn: Callable | Mapping, setup: Callable | None, ready: list) -> tuple:
    key = row["record"], row["model"]
    if row.get("error"):
        return (*key, None, row["error"])
    try:
        own = fn[row["model"]] if isinstance(fn, Mapping) else fn
        if setup is None:
            answer = own(row)
        else:
            if not ready:
                ready.append(setup())
            answer = own(row, ready[0])
        if answer is not None and not isinstance(answer, str):
            raise TypeError(f"the answer is no text but {type(answer).__name__}")
        return (*key, answer, None)
    except Exception as error:  # whatever a user's generator raises belongs to its row
        return (*key, None, str(error) or type(error).__name__)


def with_response(raw: DataFrame) -> DataFrame:
    """Errors take the place of the response, as the plain response log has it."""
    return raw.withColumn("response", F.coalesce("response", "error"))


def to_artifacts(raw: DataFrame, rendered: str | None = None) -> DataFrame:
    """Markup of every response: ``run_time, model, record, markup, has_markup,
    has_render, response``.

    ``rendered`` names a boolean column telling whether the markup could be
    drawn; without it every extracted markup counts as drawn.
    """
    found = raw.withColumn("markup", extract_markup(F.col("response")))
    has = F.col("markup").isNotNull()
    drawn = has if rendered is None else has & F.coalesce(F.col(rendered), F.lit(False))
    return found.select(
        "run_time",
        "model",
        "record",
        "markup",
        has.alias("has_markup"),
        drawn.alias("has_render"),
        "response",
    )
