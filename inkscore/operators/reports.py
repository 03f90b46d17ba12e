"""Tables behind the charts and image grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscore.operators.grid import METRICS

# Fixed values, as the tables must equal those published: the room for the label
# above each cell, and the status of a cell without an image.
LABEL_HEIGHT = 30
NOT_FOUND = "Image not found"


def chart_table(summary: DataFrame) -> DataFrame:
    """``model, pos, metric, value``, metrics in their fixed order.

    Columns before ``model``, as the run of a summary by run, stay in front.
    """
    lead = summary.columns[: summary.columns.index("model")]
    order = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric")).cast("int")
    long = summary.unpivot([*lead, "model"], list(METRICS), "metric", "value")
    return long.select(*lead, "model", (order - 1).alias("pos"), "metric", "value")


def comparison_manifest(
    examples: DataFrame,
    models: Sequence[str],
    artifacts: DataFrame,
    records: Sequence[int],
    width: int,
    height: int,
    gap: int = 8,
) -> DataFrame:
    """Cells of the comparison grid: chosen records by (target, models).

    ``record, row, model, col, status, x, y``; records without an example are
    left out, cells without an image carry a status instead of ``ok``.
    """
    chosen = [int(r) for r in records]
    places = F.array(
        *[F.struct(F.lit(i).alias("row"), F.lit(r).alias("id")) for i, r in enumerate(chosen)]
    )
    mine = F.filter(places, lambda place: place["id"] == F.col("record"))
    rows = (
        examples.where(F.col("record").isin(chosen))
        .select("record", F.explode(mine).alias("place"))
        .select("record", "place.row")
    )
    names = F.array(*[F.lit(m) for m in ("target", *models)])
    cells = rows.select("record", "row", F.posexplode(names).alias("col", "model"))
    images = (
        artifacts.where(F.col("record").isin(chosen) & F.col("has_render"))
        .select("record", "model")
        .distinct()
        .withColumn("found", F.lit(True))
    )
    shown = F.col("found") | (F.col("model") == "target")
    return cells.join(images, ["record", "model"], "left").select(
        "record",
        "row",
        "model",
        "col",
        F.when(shown, "ok").otherwise(NOT_FOUND).alias("status"),
        (F.col("col") * (width + gap)).alias("x"),
        (F.col("row") * (height + LABEL_HEIGHT + gap)).alias("y"),
    )


def comparison_pivot(manifest: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per chosen record with the status of each model."""
    return (
        manifest.groupBy("row", "record")
        .pivot("model", ["target", *models])
        .agg(F.first("status"))
    )


def grid_layout(
    df: DataFrame, width: int, height: int, n: int = 32, cols: int = 8, gap: int = 8
) -> DataFrame:
    """Place and canvas of the first ``n`` records in a grid of ``cols`` columns."""
    lines = -(-n // cols)
    row = F.floor(F.col("record") / cols)
    col = F.col("record") % cols
    return df.where((F.col("record") >= 0) & (F.col("record") < n)).select(
        "record",
        row.cast("int").alias("row"),
        col.cast("int").alias("col"),
        (col * (width + gap)).cast("int").alias("x"),
        (row * (height + gap)).cast("int").alias("y"),
        F.lit(width * cols + gap * (cols - 1)).alias("canvas_width"),
        F.lit(height * lines + gap * (lines - 1)).alias("canvas_height"),
    )
