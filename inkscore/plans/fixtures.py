"""Evaluation inputs derived from the given tables.

The given tables hold no markup, data URLs or images, so web pages stand in for
targets, embeddings for rasters and events for score rows. Every row of the
source table is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscore.operators.images import pack_rgb
from inkscore.operators.skew import pair_all

RUNS = ("2025-01-10_08-00-00", "2025-01-11_09-30-00")
MODELS = ("m_exact", "m_alt", "m_trunc")
SIDE = 8  # embeddings of 64 values become 8 x 8 rasters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eval_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: ``record, title, image, width, height, completion`` from pages; the
    drawn text is all that a page shows."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("record"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.md5("url").alias("image"),
        F.md5("html").alias("extra"),
        F.regexp_replace("html", "<[^>]*>", " ").alias("shown"),
        (200 + (F.col("page_id") % 5) * 40).cast("int").alias("width"),
        (280 + (F.col("page_id") % 3) * 20).cast("int").alias("height"),
    )
    completion = F.concat(
        F.format_string('<svg width="%d" height="%d"><text>', "width", "height"),
        "shown",
        F.lit('</text><image href="data:image/png;base64,'),
        "image",
        F.lit('"/>'),
        F.when(
            F.col("record") % 3 == 0,
            F.concat(F.lit('<image href="data:image/jpeg;base64,'), "extra", F.lit('"/>')),
        ).otherwise(""),
        F.lit("</svg>"),
    )
    return pages.select("record", "title", "image", "width", "height", completion.alias("completion"))


def model_groups(spark: SparkSession) -> DataFrame:
    """The (run_time, model) pairs there are outputs for; one model sat out a run."""
    rows = [(r, m) for r in RUNS for m in MODELS if (r, m) != (RUNS[1], "m_trunc")]
    return spark.createDataFrame(rows, "run_time string, model string")


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_time, model, record, response, rendered``: an exact copy within
    chatter, a refusal, a cut-off answer, placeholder URLs, undrawable markup."""
    examples = eval_examples(spark, sf_dir)
    other = examples.select(
        (F.col("record") + 1 - 2 * (F.col("record") % 2)).alias("record"),
        F.col("title").alias("other"),
    )
    base = pair_all(examples.join(other, "record", "left"), model_groups(spark))
    record, completion = F.col("record"), F.col("completion")
    exact = F.concat(F.lit("Here you go:\n"), completion, F.lit(" done."))
    swapped = F.concat(
        F.format_string('<svg width="%d"><text>', "width"),
        F.coalesce("other", F.lit("none")),
        F.lit('</text><image href="cdn://1.jpg"/></svg>'),
    )
    short = F.concat(
        F.format_string('<svg width="%d" height="%d"><text>', "width", "height"),
        F.substring("title", 1, 30),
        F.lit("</text></svg>"),
    )
    cut = F.substring(completion, F.lit(1), F.length(completion) - 6)
    response = (
        F.when(F.col("model") == "m_exact", exact)
        .when(
            F.col("model") == "m_alt",
            F.when(record % 11 == 0, "Sorry, I cannot draw this.").otherwise(swapped),
        )
        .otherwise(F.when(record % 7 == 0, cut).otherwise(short))
    )
    rendered = ~((F.col("model") == "m_trunc") & (record % 5 == 0))
    return base.select(
        "run_time", "model", "record", response.alias("response"), rendered.alias("rendered")
    )


def _pixel_value(value, channel):
    """Channel value 0..255 of one embedding entry."""
    level = F.floor((value.cast("double") + 0.6) * (212.5 - 20 * channel))
    return F.least(F.lit(255), F.greatest(F.lit(0), level)).cast("int")


def _height(ragged: bool):
    """Images whose first value is low are two rows short in the ragged set."""
    low = F.col("embedding")[0].cast("double") < -0.15
    return F.when(low, SIDE - 2).otherwise(SIDE) if ragged else F.lit(SIDE)


def image_pixels(spark: SparkSession, sf_dir: str, ragged: bool = False) -> DataFrame:
    """``image_id, y, x, c, v``: 8 x 8 rasters of three channels."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        _height(ragged).alias("h"),
        F.posexplode("embedding").alias("i", "e"),
    )
    cells = rows.select(
        "image_id",
        F.expr(f"CAST(i DIV {SIDE} AS INT)").alias("y"),
        (F.col("i") % SIDE).cast("int").alias("x"),
        "e",
        "h",
        F.explode(F.array(*[F.lit(c) for c in range(3)])).alias("c"),
    )
    return cells.where(F.col("y") < F.col("h")).select(
        "image_id", "y", "x", "c", _pixel_value(F.col("e"), F.col("c")).alias("v")
    )


def packed_images(spark: SparkSession, sf_dir: str, ragged: bool = False) -> DataFrame:
    """``image_id, image``: the same rasters as packed bytes."""
    kept = F.slice("embedding", F.lit(1), F.col("h") * SIDE)
    values = F.flatten(
        F.transform(kept, lambda e: F.array(*[_pixel_value(e, F.lit(c)) for c in range(3)]))
    )
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("image_id"), "embedding", _height(ragged).alias("h"))
        .select("image_id", pack_rgb(F.col("h"), F.lit(SIDE), values).alias("image"))
    )


def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gen_id, tgt_id``: each image with the next one."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gen_id"))
    known = ids.select(F.col("gen_id").alias("tgt_id"))
    return ids.select("gen_id", (F.col("gen_id") + 1).alias("tgt_id")).join(known, "tgt_id").select(
        "gen_id", "tgt_id"
    )


def tiled_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 x 16 rasters, each tiled from four consecutive 8 x 8 ones."""
    quarter = F.col("image_id") % 4
    return image_pixels(spark, sf_dir).select(
        F.expr("image_id DIV 4").alias("image_id"),
        (F.col("y") + SIDE * F.floor(quarter / 2)).cast("int").alias("y"),
        (F.col("x") + SIDE * (quarter % 2)).cast("int").alias("x"),
        "c",
        "v",
    )


def large_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of images of 1,024 x 1,024 (odd ones of 896 rows): a hundred consecutive
    rasters side by side, repeated to the right and downwards."""
    quad = F.col("vec_id") % 100
    values = F.transform("e", lambda e: F.concat(*[F.lpad(F.hex(_pixel_value(e, F.lit(c))), 2, "0") for c in range(3)]))
    lines = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id DIV 100").alias("image_id"),
        F.floor(quad / 10).alias("band"),
        (quad % 10).alias("place"),
        F.posexplode(F.expr(f"transform(sequence(0, {SIDE - 1}), r -> slice(embedding, {SIDE} * r + 1, {SIDE}))")).alias("r", "e"),
    )
    cell = F.struct("place", F.array_join(values, "").alias("hex"))
    rows = lines.groupBy("image_id", (F.col("band") * SIDE + F.col("r")).alias("r")).agg(
        F.sort_array(F.collect_list(cell)).alias("cells")
    )
    line = F.array_join(F.transform("cells", lambda c: c["hex"]), "")
    long = F.substring(F.repeat(line, 13), 1, 6 * 1024)
    height = F.when(F.col("image_id") % 2 == 0, 1024).otherwise(896)
    below = F.explode(F.expr("transform(sequence(0, 12), t -> CAST(80 * t + r AS INT))"))
    tall = rows.select("image_id", height.alias("height"), long.alias("hex"), below.alias("y"))
    placed = tall.where("y < height").withColumn("s", F.floor(F.col("y") / 200))
    strips = placed.groupBy("image_id", "height", "s").agg(F.sort_array(F.collect_list(F.struct("y", "hex"))).alias("rows"))
    rgb = F.unhex(F.array_join(F.transform("rows", lambda x: x["hex"]), ""))
    top = (200 * F.col("s")).cast("int").alias("y")
    return strips.select("image_id", "height", F.lit(1024).alias("width"), top, rgb.alias("rgb"))


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_time, record, model, bleu, structural, pixel, has_markup, has_render``."""
    failed = (F.col("event_id") % 16 == 0) | (F.col("event_type") == "error")

    def value(good):
        return F.when(failed, 0.0).otherwise(good)

    return table(spark, sf_dir, "events").select(
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("_00-00-00")).alias("run_time"),
        F.col("event_id").alias("record"),
        F.concat(F.lit("m_"), "event_type").alias("model"),
        value(F.col("value") / 500).alias("bleu"),
        value(1 - F.col("value") / 1000).alias("structural"),
        value((F.col("event_id") % 1000) / 1000).alias("pixel"),
        (F.col("event_id") % 32 != 0).alias("has_markup"),
        (F.col("event_id") % 16 != 0).alias("has_render"),
    )


def _neighbours(df: DataFrame, key: str, text: str) -> DataFrame:
    other = df.select(
        (F.col(key) + 1 - 2 * (F.col(key) % 2)).alias("pair_id"), F.col(text).alias("ref")
    )
    return df.select(F.col(key).alias("pair_id"), F.col(text).alias("cand")).join(other, "pair_id")


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, cand, ref``: each document with its neighbour."""
    return _neighbours(table(spark, sf_dir, "documents"), "doc_id", "text")


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(table(spark, sf_dir, "pages"), "page_id", "html")
