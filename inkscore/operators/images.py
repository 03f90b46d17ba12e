"""Image comparison on packed images: one row per image, three bytes a pixel.

This is the form for large images: a join moves three bytes a pixel once, where
a pixel table moves some forty bytes a pixel several times. Spark joins the two
images of a pair into one row; the arithmetic on the bytes of that row is numpy
inside Arrow batches. Packed image: ``height INT, width INT, rgb BINARY`` with
the bytes in (y, x, channel) order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkscore.operators.pixels import C1, C2, LOBES, WEIGHT_BITS, WINDOW

STRIP = 256  # rows of windows worked on at a time, to bound the working memory

PIXEL_SCHEMA = "image_id {id}, y INT, x INT, c INT, v INT"


def pack_rgb(height: Column, width: Column, values: Column) -> Column:
    """Packed image from an array<int> of channel values in (y, x, channel) order."""
    hexes = F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0"))
    return F.struct(
        height.cast("int").alias("height"),
        width.cast("int").alias("width"),
        F.unhex(F.array_join(hexes, "")).alias("rgb"),
    )


def unpack_pixels(images: DataFrame) -> DataFrame:
    """Long pixel table of ``image_id, image`` rows (``image`` packed)."""
    schema = PIXEL_SCHEMA.format(id=images.schema["image_id"].dataType.simpleString())

    def explode(batches):
        for batch in batches:
            for key, h, w, data in zip(batch.image_id, batch.height, batch.width, batch.rgb):
                y, x, c = np.indices((h, w, 3)).reshape(3, -1)
                values = np.frombuffer(data, np.uint8)
                yield pd.DataFrame({"image_id": key, "y": y, "x": x, "c": c, "v": values})

    flat = images.where(F.col("image").isNotNull()).select("image_id", "image.*")
    return flat.mapInPandas(explode, schema)


def image_scores(gen: Column, tgt: Column, mode: str = "wrap") -> Column:
    """struct<structural, pixel> of a packed image pair, (0, 0) where it fails."""

    @F.pandas_udf("structural double, pixel double")
    def compare(
        gh: pd.Series, gw: pd.Series, g: pd.Series, th: pd.Series, tw: pd.Series, t: pd.Series
    ) -> pd.DataFrame:
        rows = [_compare(*row, mode) for row in zip(gh, gw, g, th, tw, t)]
        return pd.DataFrame(rows, columns=["structural", "pixel"], dtype="float64")

    sides = [side[field] for side in (gen, tgt) for field in ("height", "width", "rgb")]
    return compare(*sides)


def image_similarity_packed(
    pairs: DataFrame, keys: list[str], mode: str = "wrap"
) -> DataFrame:
    """``keys, structural, pixel`` of rows holding packed ``gen`` and ``tgt``."""
    scored = pairs.select(*keys, image_scores(F.col("gen"), F.col("tgt"), mode).alias("s"))
    return scored.select(*keys, "s.structural", "s.pixel")


def _compare(gh, gw, g, th, tw, t, mode):
    if g is None or t is None:
        return 0.0, 0.0
    gh, gw, th, tw = int(gh), int(gw), int(th), int(tw)
    if min(th, tw) < WINDOW or len(g) != gh * gw * 3 or len(t) != th * tw * 3:
        return 0.0, 0.0
    a = np.frombuffer(g, np.uint8).reshape(gh, gw, 3)
    b = np.frombuffer(t, np.uint8).reshape(th, tw, 3)
    a = _resample(_resample(a, tw, 1), th, 0)
    return _ssim(a, b), _pixel(a, b, mode)


def _pixel(a, b, mode):
    gap = a - b if mode == "wrap" else np.abs(a.astype(np.int16) - b)
    return 1 - gap.sum(dtype=np.int64) / gap.size / 255


def _box_sums(values):
    for axis in (0, 1):
        total = np.cumsum(values, axis=axis, dtype=np.int64)
        total = np.insert(total, 0, 0, axis=axis)
        n = total.shape[axis]
        values = np.take(total, range(WINDOW, n), axis) - np.take(total, range(n - WINDOW), axis)
    return values.astype(np.float64)


def ssim_sums(a, b):
    """Sum and number of the similarities of all windows of two images."""
    area = WINDOW * WINDOW
    unbias = area / (area - 1)
    rows = a.shape[0] - WINDOW + 1
    total, count = 0.0, 0
    for top in range(0, rows, STRIP):
        p, q = (side[top : top + STRIP + WINDOW - 1].astype(np.int64) for side in (a, b))
        mp, mq, pp, qq, pq = (_box_sums(m) / area for m in (p, q, p * p, q * q, p * q))
        spread = unbias * (pp - mp * mp) + unbias * (qq - mq * mq) + C2
        common = 2 * unbias * (pq - mp * mq) + C2
        value = (2 * mp * mq + C1) * common / ((mp * mp + mq * mq + C1) * spread)
        total, count = total + value.sum(), count + value.size
    return total, count


def _ssim(a, b):
    total, count = ssim_sums(a, b)
    return total / count


_TAPS = {}


def _taps(n_in, n_out):
    """First input cell, and whole-number Lanczos weights, of each output cell.

    (n_out,) and (n_out, reach): as many columns as a cell reaches inputs, zero where
    it reaches fewer. The last pairs of sizes are remembered.
    """
    if (n_in, n_out) not in _TAPS:
        if len(_TAPS) >= 64:
            _TAPS.clear()
        _TAPS[n_in, n_out] = _make_taps(n_in, n_out)
    return _TAPS[n_in, n_out]


def _make_taps(n_in, n_out):
    scale = n_in / n_out
    stretch = max(scale, 1.0)
    centre = (np.arange(n_out) + 0.5) * scale
    first = np.maximum(np.floor(centre - LOBES * stretch + 0.5), 0).astype(np.int64)
    last = np.minimum(np.floor(centre + LOBES * stretch + 0.5), n_in).astype(np.int64)
    cell = first[:, None] + np.arange((last - first).max())
    x = (cell - centre[:, None] + 0.5) / stretch
    inside = (x >= -LOBES) & (x < LOBES) & (cell < last[:, None])
    w = np.where(inside, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    fixed = w / w.sum(axis=1, keepdims=True) * (1 << WEIGHT_BITS)
    return first, np.where(fixed < 0, np.ceil(fixed - 0.5), np.floor(fixed + 0.5)).astype(np.int64)


def resample_rows(rows, low, n_in, n_out, wanted):
    """Output rows ``wanted`` (a range) of an image of ``n_in`` rows, of which
    ``rows`` are those from ``low`` on that they reach."""
    first, weights = _taps(n_in, n_out)
    first, weights = first[wanted.start : wanted.stop], weights[wanted.start : wanted.stop]
    total = np.zeros((len(first), *rows.shape[1:]), np.int64)
    for k in range(weights.shape[1]):
        # Where a cell reaches fewer rows its weight is zero, whatever row is taken.
        own = rows[np.minimum(first + k - low, len(rows) - 1)]
        total += own * weights[:, k].reshape(-1, *[1] * (rows.ndim - 1))
    return np.clip((total + (1 << (WEIGHT_BITS - 1))) >> WEIGHT_BITS, 0, 255).astype(np.uint8)


def _resample(image, n_out, axis):
    n_in = image.shape[axis]
    if n_in == n_out:
        return image
    moved = np.moveaxis(image, axis, 0)
    return np.moveaxis(resample_rows(moved, 0, n_in, n_out, range(n_out)), 0, axis)
