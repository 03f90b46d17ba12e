"""Quality bands of the three metrics and labels for metrics that disagree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the top and middle band of each metric.
BANDS = {
    "bleu": (0.7, 0.4, ("near_perfect", "good_structure", "different")),
    "structural": (0.95, 0.80, ("identical", "minor_differences", "noticeable_differences")),
    "pixel": (1.0, 0.9, ("perfect", "nearly_identical", "significant_differences")),
}


def band(value: Column, metric: str) -> Column:
    top, middle, (high, mid, low) = BANDS[metric]
    return (
        F.when(value.isNull(), F.lit(None))
        .when(value >= top, high)
        .when(value >= middle, mid)
        .otherwise(low)
    )


def disagreement(bleu: Column, structural: Column, pixel: Column) -> Column:
    """Which of the documented scenarios a row shows, NULL for none."""
    code_top, code_mid, _ = BANDS["bleu"]
    view_top, view_mid, _ = BANDS["structural"]
    exact_top, exact_mid, _ = BANDS["pixel"]
    return (
        F.when(
            (bleu >= code_top) & (structural < view_mid) & (pixel < exact_mid),
            "code_good_image_bad",
        )
        .when(
            (bleu < code_mid) & (structural >= view_top) & (pixel >= exact_top),
            "code_bad_image_good",
        )
        .when((structural >= view_top) & (pixel < exact_mid), "structural_good_pixel_bad")
    )
