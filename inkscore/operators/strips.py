"""Images of any size as packed strips: rows of ``image_id, height, width, y, rgb``.

A strip holds consecutive rows of its image from ``y`` on, at most ``strip_bytes``
of them (one row, if that is wider). No row of any table here holds an image: work that
reaches over the edge of a strip brings along the few rows it reaches (a halo).
Resampling reaches as many as the taps of a cell; a window of the structural
similarity reaches six below, so its sums come from a table of prefix sums of each
strip and its halo alone. Bytes cross one exchange for resampling, and one for
comparing; what is added up after that are two sums a strip.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkscore.operators.images import _resample, resample_rows, ssim_sums
from inkscore.operators.pixels import LOBES, WINDOW, image_sizes

STRIP_BYTES = 1 << 20
HALO = WINDOW - 1
COLUMNS = ("image_id", "height", "width", "y", "rgb")


def _room(width: Column, strip_bytes: int) -> Column:
    """Rows of that width in a strip."""
    return F.greatest(F.floor(F.lit(strip_bytes) / (3 * width)), F.lit(1)).cast("int")


def _part(low: Column, high: Column) -> Column:
    """The bytes of the rows ``low`` .. ``high`` - 1 of a strip."""
    line = 3 * F.col("width")
    return F.substring("rgb", (low - F.col("y")) * line + 1, (high - low) * line)


def _end() -> Column:
    """The row after a strip's last one."""
    return F.col("y") + (F.octet_length("rgb") / (3 * F.col("width"))).cast("int")


def cut_strips(images: DataFrame, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """Strips of packed images (``image_id, image``); broken images have none."""
    flat = images.select("image_id", "image.*").where(
        (F.col("height") > 0) & (F.col("width") > 0)
        & (F.octet_length("rgb") == F.col("height").cast("long") * F.col("width") * 3)
    )
    whole = flat.withColumn("y", F.lit(0))
    room = _room(F.col("width"), strip_bytes)
    cut = whole.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("height") - 1, room)))
    part = _part(F.col("_at"), F.least(F.col("_at") + room, "height"))
    return cut.select("image_id", "height", "width", F.col("_at").alias("y"), part.alias("rgb"))


def strips_of_pixels(pixels: DataFrame, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """Strips of a pixel table (``image_id, y, x, c, v``); images with holes have none."""
    sizes = image_sizes(pixels).where("complete").select(
        "image_id", F.col("h").alias("height"), F.col("w").alias("width")
    )
    room = _room(F.col("width"), strip_bytes)
    placed = pixels.join(sizes, "image_id").withColumn("_y", F.expr("y") - F.pmod("y", room))
    # A value's hex digits follow its place.
    cell = F.struct("y", "x", "c", F.lpad(F.hex("v"), 2, "0").alias("d"))
    packed = placed.groupBy("image_id", "height", "width", "_y").agg(F.sort_array(F.collect_list(cell)).alias("p"))
    rgb = F.unhex(F.array_join(F.transform("p", lambda p: p["d"]), ""))
    return packed.select("image_id", "height", "width", F.col("_y").alias("y"), rgb.alias("rgb"))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by ``keys`` over all shuffle partitions: a strip is few bytes for the work
    it makes, so its partitions are not to be put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _array(rgb: bytes, width: int) -> np.ndarray:
    return np.frombuffer(rgb, np.uint8).reshape(-1, width, 3)


def _typed(make: Callable[[dict], dict], kinds: list[tuple[str, pa.DataType]]) -> Callable:
    """A function for mapInArrow that makes a row, of these columns, of each row."""
    schema = pa.schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                values = make({n: batch.column(n)[at].as_py() for n in batch.schema.names})
                arrays = [pa.array([values[f.name]], f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _kind(df: DataFrame, name: str) -> tuple[T.DataType, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[name].dataType
    return kind, to_arrow_type(kind)


def resample_strips(strips: DataFrame, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """Lanczos resampling of every image to its ``out_w, out_h`` (columns beside the
    strip's): strips of ``image_id, height, width, y, rgb``.

    Rows are resampled where they are; for the columns each new strip gathers the
    rows its cells reach, and is as low as keeps these within ``strip_bytes``.
    """
    spark_kind, kind = _kind(strips, "image_id")
    numbers = [(n, pa.int32()) for n in ("height", "width", "y", "out_h")]

    def across(row: dict) -> dict:
        image = _resample(_array(row["rgb"], row["width"]), row["out_w"], 1)
        return row | {"width": row["out_w"], "rgb": image.tobytes()}

    schema = T.StructType(
        [T.StructField("image_id", spark_kind)]
        + [T.StructField(n, T.IntegerType()) for n, _ in numbers]
        + [T.StructField("rgb", T.BinaryType())]
    )
    ints = [F.col(n).cast("int").alias(n) for n in ("height", "width", "y", "out_w", "out_h")]
    narrow = strips.select("image_id", *ints, "rgb").mapInArrow(
        _typed(across, [("image_id", kind), *numbers, ("rgb", pa.binary())]), schema
    )

    scale = F.col("height") / F.col("out_h")
    reach = LOBES * F.greatest(scale, F.lit(1.0))
    room = _room(F.col("width"), strip_bytes)
    # Input rows of an output strip are about as many as fit a strip.
    rows = F.greatest(F.floor(F.least(F.lit(1.0), 1 / scale) * room), F.lit(1)).cast("int")
    sized = narrow.withColumn("_rows", rows).withColumn("_end", _end())
    least = F.floor(((F.col("y") - reach - 1) / scale - 1) / F.col("_rows"))
    most = F.ceil(((F.col("_end") + reach + 1) / scale + 1) / F.col("_rows"))
    final = F.floor((F.col("out_h") - 1) / F.col("_rows"))
    range_of = F.sequence(F.greatest(least, F.lit(0)).cast("int"), F.least(most, final).cast("int"))
    met = sized.withColumn("_s", F.explode(range_of))
    top = F.col("_s") * F.col("_rows")
    bottom = F.least(top + F.col("_rows"), "out_h")
    low = F.greatest(F.floor((top + 0.5) * scale - reach + 0.5), F.lit(0)).cast("int")
    high = F.least(F.floor((bottom - 0.5) * scale + reach + 0.5), "height").cast("int")
    met = met.withColumns({"_low": F.greatest(low, "y"), "_high": F.least(high, "_end")})
    met = met.where("_low < _high").withColumns({"_part": _part(F.col("_low"), F.col("_high")), "_top": top, "_bottom": bottom})
    place = ("image_id", "height", "width", "out_h", "_top", "_bottom")
    gathered = _spread(met, *place).groupBy(*place).agg(
        F.sort_array(F.collect_list(F.struct("_low", "_part"))).alias("parts")
    )

    def down(row: dict) -> dict:
        image = _array(b"".join(p["_part"] for p in row["parts"]), row["width"])
        low = row["parts"][0]["_low"]
        wanted = range(row["_top"], row["_bottom"])
        if row["height"] == row["out_h"]:
            made = image[wanted.start - low : wanted.stop - low]
        else:
            made = resample_rows(image, low, row["height"], row["out_h"], wanted)
        return row | {"height": row["out_h"], "y": row["_top"], "rgb": made.tobytes()}

    kinds = [("image_id", kind), ("height", pa.int32()), ("width", pa.int32()), ("y", pa.int32()), ("rgb", pa.binary())]
    return gathered.mapInArrow(_typed(down, kinds), T.StructType([schema[n] for n, _ in kinds]))


def _cells(strips: DataFrame, strip_bytes: int) -> DataFrame:
    """Strips of one grid with their halo: image_id, height, width, s, top, rows."""
    room = _room(F.col("width"), strip_bytes)
    sized = strips.withColumn("_room", room).withColumn("_end", _end())
    first = F.floor((F.col("y") - HALO) / F.col("_room"))
    last = F.floor((F.col("_end") - 1) / F.col("_room"))
    met = sized.withColumn("s", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("int"), last.cast("int"))))
    top = F.col("s") * F.col("_room")
    low, high = F.greatest(top, F.col("y")), F.least(top + F.col("_room") + HALO, "_end")
    parts = met.withColumns({"_low": low, "_part": _part(low, high), "own": F.col("_room")}).where(low < high)
    return parts.groupBy("image_id", "height", "width", "s", "own").agg(
        F.sort_array(F.collect_list(F.struct("_low", "_part"))).alias("parts")
    )


def _whole(strips: DataFrame) -> DataFrame:
    """``image_id, height, width`` of the images whose strips, put together, are all
    of their rows, each once; of a strip only its place and length are gathered."""
    line = 3 * F.col("width")
    filled = (F.col("width") > 0) & (F.col("y") >= 0)
    # A length that is no whole number of rows gives NULL, which ends the chain.
    end = F.when(filled, F.when(F.octet_length("rgb") % line == 0, _end()))
    span = F.struct(F.col("y").cast("long").alias("y"), end.cast("long").alias("end"))
    images = strips.groupBy("image_id").agg(
        *[f(n).alias(f"_{k}_{n}") for n in ("height", "width") for k, f in (("low", F.min), ("high", F.max))],
        F.sort_array(F.collect_list(span)).alias("spans"),
    )
    reached = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda at, s: F.when(s["y"] == at, s["end"]).otherwise(F.lit(-1).cast("long"))
    )
    alike = (F.col("_low_height") == F.col("_high_height")) & (F.col("_low_width") == F.col("_high_width"))
    return images.where(alike & (reached == F.col("_high_height"))).select(
        "image_id", F.col("_high_height").alias("height"), F.col("_high_width").alias("width")
    )


def strip_similarity(
    gen: DataFrame, tgt: DataFrame, pairs: DataFrame, mode: str = "wrap", strip_bytes: int = STRIP_BYTES
) -> DataFrame:
    """``gen_id, tgt_id, structural, pixel`` of every pair in ``pairs``.

    ``gen`` and ``tgt`` are strips, cut in any way. A generated image of another size
    is resampled, once for each size that is asked of it. A pair that cannot be
    compared (an image missing, or with strips that are not all of its rows once, a target
    side below seven) gets 0 for both scores.
    """

    known = pairs.join(_whole(tgt).toDF("tgt_id", "out_h", "out_w"), "tgt_id")
    known = known.join(_whole(gen).select(F.col("image_id").alias("gen_id")), "gen_id")
    usable = known.where((F.col("out_h") >= WINDOW) & (F.col("out_w") >= WINDOW))
    usable = usable.select("gen_id", "tgt_id", "out_h", "out_w").distinct()
    wanted = usable.select(F.col("gen_id").alias("image_id"), "out_h", "out_w").distinct()
    ours = gen.join(wanted, "image_id")
    same = (F.col("height") == F.col("out_h")) & (F.col("width") == F.col("out_w"))
    sized = ours.where(same).select(*COLUMNS).unionByName(resample_strips(ours.where(~same), strip_bytes))

    a = _cells(sized, strip_bytes).select(
        F.col("image_id").alias("gen_id"), F.col("height").alias("out_h"), F.col("width").alias("out_w"),
        "s", "own", F.col("parts").alias("a"),
    )
    b = _cells(tgt, strip_bytes).select(
        F.col("image_id").alias("tgt_id"), "s", F.col("parts").alias("b"), F.col("width").alias("w")
    )
    met = usable.join(a, ["gen_id", "out_h", "out_w"])
    met = _spread(met, "tgt_id", "s").join(_spread(b, "tgt_id", "s"), ["tgt_id", "s"])
    (gen_kind, gen_arrow), (tgt_kind, tgt_arrow) = _kind(pairs, "gen_id"), _kind(pairs, "tgt_id")

    def compare(row: dict) -> dict:
        p, q = (_array(b"".join(x["_part"] for x in row[side]), row["w"]) for side in ("a", "b"))
        total, count = 0.0, 0
        windows = min(len(p), row["own"] + HALO)
        if windows >= WINDOW:
            total, count = ssim_sums(p[:windows], q[:windows])
        p, q = p[: row["own"]], q[: row["own"]]
        gap = p - q if mode == "wrap" else np.abs(p.astype(np.int16) - q)
        return row | {"total": float(total), "count": int(count), "gap": int(gap.sum(dtype=np.int64)), "n": gap.size}

    kinds = [("gen_id", gen_arrow), ("tgt_id", tgt_arrow), ("total", pa.float64())]
    kinds += [(n, pa.int64()) for n in ("count", "gap", "n")]
    schema = T.StructType(
        [T.StructField("gen_id", gen_kind), T.StructField("tgt_id", tgt_kind), T.StructField("total", T.DoubleType())]
        + [T.StructField(n, T.LongType()) for n in ("count", "gap", "n")]
    )
    sums = met.select("gen_id", "tgt_id", "own", "w", "a", "b").mapInArrow(_typed(compare, kinds), schema)
    scores = sums.groupBy("gen_id", "tgt_id").agg(
        (F.sum("total") / F.sum("count")).alias("structural"),
        (1 - F.sum("gap") / F.sum("n") / 255).alias("pixel"),
    )
    return pairs.join(scores, ["gen_id", "tgt_id"], "left").select(
        "gen_id", "tgt_id",
        F.coalesce("structural", F.lit(0.0)).alias("structural"),
        F.coalesce("pixel", F.lit(0.0)).alias("pixel"),
    )
