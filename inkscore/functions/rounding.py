"""Rounding to three significant figures, and sums whose means survive it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sig3(value: Column) -> Column:
    """Three significant figures of a double, as Python's ``.3g`` gives them.

    A decimal-format pattern rounds half to even on the exact binary value, so
    0.1235 becomes 0.123; ``format_string('%.3g')`` rounds the shortest decimal
    half up and gives 0.124. NULL, NaN and the infinities pass through.
    """
    value = value.cast("double")
    text = F.call_function("format_number", value, F.lit("0.00E0"))
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(finite, text.cast("double")).otherwise(value)


_UNIT = float(1 << 60)


def steady_parts(value: Column) -> tuple[Column, Column]:
    """Aggregates: the sum of ``value`` in whole multiples of 2^-60, and of what is left."""
    units = F.when(F.abs(value) < 8, (value * _UNIT).cast("bigint")).otherwise(0)
    return F.sum(units.cast("decimal(20,0)")).cast("decimal(38,0)"), F.sum(value - units / _UNIT)


def steady_total(units: Column, rest: Column) -> Column:
    return units.cast("double") / _UNIT + rest


def steady_sum(value: Column) -> Column:
    """Sum (aggregate) that does not depend on the order of the rows.

    A mean of rounded scores is often an exact tie, where the last bit of the
    sum decides the third figure. Multiples of 2^-60 are summed as whole
    numbers, only what is left below them (or a value of 8 and more) as doubles.
    """
    return steady_total(*steady_parts(value))
