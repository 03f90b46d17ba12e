"""Image comparison on long pixel tables: ``keys, y, x, c, v``.

Everything here is joins, windows and sums of whole numbers, grouped by single
pixel rows or columns, so one very large image is spread like many small ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkscore.operators.skew import heavy_keys, salted_join

WINDOW = 7  # side of the SSIM window
# Stabilising constants (0.01 * 255)^2 and (0.03 * 255)^2.
C1 = 6.5025
C2 = 58.5225
# Fixed values of the 8-bit Lanczos resampling: lobes, and fraction bits of the weights.
LOBES = 3
WEIGHT_BITS = 22
# A weight table up to this many rows (about 24 bytes each) is broadcast.
BROADCAST_WEIGHTS = 1_000_000


def image_sizes(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """``key, w, h, complete`` of every image; an image with holes is not complete."""
    sizes = pixels.groupBy(key).agg(
        (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.count("v").alias("n")
    )
    return sizes.select(key, "w", "h", (F.col("n") == 3 * F.col("w") * F.col("h")).alias("complete"))


def pair_pixels(
    gen: DataFrame, tgt: DataFrame, pairs: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """Generated (a) and target (b) values of every pair, side by side.

    ``pairs`` holds ``gen_id, tgt_id``. Images shown in very many pairs are met
    by a salted join; the target is then met pixel by pixel. A pair of different
    sizes, or with an image that has holes, cannot be compared and gives no row.
    """
    whole = F.col("complete")
    ours_is = image_sizes(gen).where(whole).drop("complete").withColumnRenamed("image_id", "gen_id")
    theirs_is = image_sizes(tgt).where(whole).drop("complete").withColumnRenamed("image_id", "tgt_id")
    if hot is None:
        hot = heavy_keys(pairs, "gen_id")
    sized = salted_join(pairs, ours_is, "gen_id", ["tgt_id"], hot=hot)
    comparable = sized.join(theirs_is, ["tgt_id", "w", "h"], "left_semi").select("gen_id", "tgt_id")
    ours = salted_join(
        comparable,
        gen.select(
            F.col("image_id").alias("gen_id"), F.struct("y", "x", "c", "v").alias("p")
        ),
        "gen_id",
        ["tgt_id"],
        hot=hot,
    ).select("gen_id", "tgt_id", "p.*")
    theirs = tgt.select(F.col("image_id").alias("tgt_id"), "y", "x", "c", F.col("v").alias("b"))
    return ours.withColumnRenamed("v", "a").join(theirs, ["tgt_id", "y", "x", "c"])


def pixel_similarity(side: DataFrame, keys: Sequence[str], mode: str = "wrap") -> DataFrame:
    """1 - mean difference / 255 of side-by-side pixels: ``keys, pixel``.

    ``mode="wrap"`` takes differences as unsigned bytes, (a - b) mod 256, which
    depends on the order of the two images; ``mode="abs"`` takes |a - b|.
    """
    delta = F.col("a") - F.col("b")
    gap = {"wrap": F.pmod(delta, F.lit(256)), "abs": F.abs(delta)}[mode]
    return side.groupBy(*keys).agg((1 - F.avg(gap) / 255).alias("pixel"))


def _ssim_value(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column) -> Column:
    mean_a, mean_b = a / n, b / n
    unbias = n / (n - 1)
    var_a = unbias * (aa / n - mean_a * mean_a)
    var_b = unbias * (bb / n - mean_b * mean_b)
    cov = unbias * (ab / n - mean_a * mean_b)
    top = (2 * mean_a * mean_b + C1) * (2 * cov + C2)
    return top / ((mean_a * mean_a + mean_b * mean_b + C1) * (var_a + var_b + C2))


def ssim(side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean structural similarity of side-by-side pixels: ``keys, structural``.

    Uniform 7 x 7 windows, sample covariance, windows that leave the image left
    out. The window sums are taken along rows, then along columns; a full window
    is one of seven neighbours in both passes, so images with a side below seven
    give no row, and windows with a hole in them are left out.
    """
    half = WINDOW // 2
    sums = ("a", "b", "aa", "bb", "ab")
    squares = side.select(
        *keys,
        "y",
        "x",
        "c",
        F.col("a").cast("long").alias("a"),
        F.col("b").cast("long").alias("b"),
    ).select(
        "*",
        (F.col("a") * F.col("a")).alias("aa"),
        (F.col("b") * F.col("b")).alias("bb"),
        (F.col("a") * F.col("b")).alias("ab"),
    )

    def slide(df: DataFrame, along: str, across: str) -> DataFrame:
        window = Window.partitionBy(*keys, "c", across).orderBy(along).rowsBetween(-half, half)
        moved = df.select(
            *keys,
            "y",
            "x",
            "c",
            F.count("*").over(window).alias("n"),
            (F.max(along).over(window) - F.min(along).over(window)).alias("reach"),
            *[F.sum(s).over(window).alias(s) for s in sums],
        )
        full = (F.col("n") == WINDOW) & (F.col("reach") == WINDOW - 1)
        return moved.where(full).drop("n", "reach")

    full = slide(slide(squares, "x", "y"), "y", "x")
    area = F.lit(float(WINDOW * WINDOW))
    value = _ssim_value(area, *[F.col(s) for s in sums])
    return full.groupBy(*keys).agg(F.avg(value).alias("structural"))


def lanczos_weights(sizes: DataFrame) -> DataFrame:
    """Whole-number weights for each ``n_in, n_out`` of ``sizes``.

    One row ``n_in, n_out, o, i, k`` per output cell o and input cell i, the
    weights of a cell adding up to about 2^22 (8-bit resampling in fixed point).
    """
    scale = F.col("n_in") / F.col("n_out")
    stretch = F.greatest(scale, F.lit(1.0))
    cells = sizes.select("n_in", "n_out", F.explode(F.expr("sequence(0, n_out - 1)")).alias("o"))
    centre = (F.col("o") + 0.5) * scale
    reach = stretch * LOBES
    first = F.greatest(F.floor(centre - reach + 0.5).cast("int"), F.lit(0))
    last = F.least(F.floor(centre + reach + 0.5).cast("int"), F.col("n_in")) - 1
    taps = cells.select(
        "*", centre.alias("centre"), stretch.alias("stretch"), F.sequence(first, last).alias("taps")
    )
    at = (F.col("i") - F.col("centre") + 0.5) / F.col("stretch")
    raw = taps.select("n_in", "n_out", "o", "centre", "stretch", F.explode("taps").alias("i"))
    raw = raw.select("n_in", "n_out", "o", "i", _lanczos(at).alias("w"))
    total = F.sum("w").over(Window.partitionBy("n_in", "n_out", "o"))
    fixed = F.col("w") / total * (1 << WEIGHT_BITS)
    rounded = F.when(fixed < 0, F.ceil(fixed - 0.5)).otherwise(F.floor(fixed + 0.5))
    return raw.select("n_in", "n_out", "o", "i", rounded.cast("long").alias("k"))


def _sinc(x: Column) -> Column:
    turn = x * F.pi()
    return F.when(x == 0, 1.0).otherwise(F.sin(turn) / turn)


def _lanczos(x: Column) -> Column:
    inside = (x >= -LOBES) & (x < LOBES)
    return F.when(inside, _sinc(x) * _sinc(x / LOBES)).otherwise(0.0)


def _clip8(total: Column) -> Column:
    value = F.shiftright(total + (1 << (WEIGHT_BITS - 1)), WEIGHT_BITS)
    return F.least(F.greatest(value, F.lit(0)), F.lit(255)).cast("int")


def resample_to(
    pixels: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str] = ("image_id",),
    broadcast_rows: int = BROADCAST_WEIGHTS,
) -> DataFrame:
    """Lanczos resampling of every image to its wanted size.

    ``sizes`` holds ``keys, w, h, out_w, out_h``. Rows first, rounded to 8 bits,
    then columns. The size pairs are few; their weight table is broadcast where
    its exact row count allows it and met by a salted join otherwise.
    """
    keys = list(keys)
    shapes = sizes.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.col(a).alias("n_in"), F.col(b).alias("n_out"))
                    for a, b in (("w", "out_w"), ("h", "out_h"))
                ]
            )
        )
    ).distinct()
    # At most this many weights: every output cell reaches over 2 * LOBES inputs.
    reach = 2 * LOBES * F.greatest(F.col("n_in") / F.col("n_out"), F.lit(1.0)) + 1
    bound = shapes.agg(F.sum(F.col("n_out") * reach)).first()[0] or 0
    table = lanczos_weights(shapes)

    def one_way(df: DataFrame, n_in: str, n_out: str, axis: str, other: str) -> DataFrame:
        weights = table.select(
            F.col("n_in").alias(n_in), F.col("n_out").alias(n_out), "o", F.col("i").alias(axis), "k"
        )
        on = [n_in, n_out, axis]
        if bound <= broadcast_rows:
            weights = F.broadcast(weights)
        else:
            salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            weights = weights.withColumn("_salt", F.explode(F.expr(f"sequence(0, {salts - 1})")))
            df = df.withColumn("_salt", F.pmod(F.xxhash64(*keys, other), F.lit(salts)).cast("int"))
            on = [*on, "_salt"]
        kept = [*keys, "w", "h", "out_w", "out_h", "c"]
        met = df.join(weights, on)
        return met.groupBy(*kept, other, F.col("o").alias(axis)).agg(
            _clip8(F.sum(F.col("v") * F.col("k"))).alias("v")
        )

    sized = pixels.join(sizes, keys)
    across = one_way(sized, "w", "out_w", "x", "y")
    down = one_way(across, "h", "out_h", "y", "x")
    return down.select(*keys, "y", "x", "c", "v")


def image_similarity(
    gen: DataFrame,
    tgt: DataFrame,
    pairs: DataFrame,
    mode: str = "wrap",
) -> DataFrame:
    """``gen_id, tgt_id, structural, pixel`` of every pair in ``pairs``.

    Generated images of another size are resampled to the target first. A pair
    that cannot be compared (an image missing or with holes, a target side below
    seven) gets 0 for both scores. Ids in very many pairs are told by the pairs alone.
    """
    whole = F.col("complete")
    gen_sizes = image_sizes(gen).where(whole).select(
        F.col("image_id").alias("gen_id"), "w", "h"
    )
    tgt_sizes = image_sizes(tgt).where(whole).select(
        F.col("image_id").alias("tgt_id"), F.col("w").alias("out_w"), F.col("h").alias("out_h")
    )
    sized = salted_join(pairs, gen_sizes, "gen_id", ["tgt_id"], hot=heavy_keys(pairs, "gen_id"))
    sized = salted_join(sized, tgt_sizes, "tgt_id", ["gen_id"], hot=heavy_keys(pairs, "tgt_id"))
    usable = sized.where((F.col("out_w") >= WINDOW) & (F.col("out_h") >= WINDOW))
    same = (F.col("w") == F.col("out_w")) & (F.col("h") == F.col("out_h"))
    ids = ["gen_id", "tgt_id"]
    raw = gen.select(F.col("image_id").alias("gen_id"), "y", "x", "c", "v")

    def values_of(chosen: DataFrame) -> DataFrame:
        # Met row by row of the image, so a popular or a huge image is many keys.
        rows = chosen.select(*ids, F.explode(F.expr("sequence(0, h - 1)")).alias("y"))
        return rows.join(raw, ["gen_id", "y"]).select(*ids, "y", "x", "c", "v")

    as_is = values_of(usable.where(same))
    odd = usable.where(~same)
    moved = resample_to(values_of(odd), odd, ids)
    values = as_is.unionByName(moved).withColumnRenamed("v", "a")
    theirs = tgt.select(F.col("image_id").alias("tgt_id"), "y", "x", "c", F.col("v").alias("b"))
    side = values.join(theirs, ["tgt_id", "y", "x", "c"])
    scores = ssim(side, ids).join(pixel_similarity(side, ids, mode), ids)
    return pairs.join(scores, ids, "left").select(
        *ids,
        F.coalesce("structural", F.lit(0.0)).alias("structural"),
        F.coalesce("pixel", F.lit(0.0)).alias("pixel"),
    )
