"""File trees: artifact inventories and raster images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscore.operators.images import unpack_pixels

PACKED_SCHEMA = "image_id STRING, image STRUCT<height: INT, width: INT, rgb: BINARY>"


def scan_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """``model, record, has_markup, has_render`` of a ``model/record.svg|png`` tree.

    Only paths are selected, so no file is opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path")
    )
    pattern = r"/([^/]+)/(\d+)\.(svg|png)$"
    named = files.where(F.col("path").rlike(pattern)).select(
        F.url_decode(F.regexp_extract("path", pattern, 1)).alias("model"),
        F.regexp_extract("path", pattern, 2).cast("bigint").alias("record"),
        F.regexp_extract("path", pattern, 3).alias("kind"),
    )
    return named.groupBy("model", "record").agg(
        F.bool_or(F.col("kind") == "svg").alias("has_markup"),
        F.bool_or(F.col("kind") == "png").alias("has_render"),
    )


def read_artifact_tree(
    spark: SparkSession, root: str, run_time: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What :func:`~inkscore.plans.scoring.score` needs, from a tree with
    ``model/record.svg``, ``model/record.png`` and ``model/record_target.png``.

    Returns artifacts (run_time, model, record, markup, has_markup, has_render),
    generated images (model, record, image) and target images (record, image). Of
    a target that lies beside several models the first path counts. Only files of
    the kind wanted are opened; a markup or drawing may be absent, and a drawing
    that cannot be read counts as absent.
    """
    place = r"/([^/]+)/(\d+)(?:_target)?\.(?:svg|png)$"

    def keyed(path: str) -> list:
        return [
            F.url_decode(F.regexp_extract(path, place, 1)).alias("model"),
            F.regexp_extract(path, place, 2).cast("bigint").alias("record"),
        ]

    options = {"recursiveFileLookup": True, "wholetext": True, "pathGlobFilter": "*[0-9].svg"}
    texts = spark.read.format("text").options(**options).load(root)
    found = texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markup"))
    markup = found.where(F.col("path").rlike(place)).select(*keyed("path"), "markup")

    images = read_images_packed(spark, root, "*[0-9].png").where(F.col("image_id").rlike(place))
    generated = images.where("image IS NOT NULL").select(*keyed("image_id"), "image")
    targets = read_images_packed(spark, root, "*_target.png").where(F.col("image_id").rlike(place))
    target = (
        targets.where("image IS NOT NULL")
        .select(keyed("image_id")[1], "image_id", "image")
        .groupBy("record")
        .agg(F.min_by("image", "image_id").alias("image"))
    )
    drawn = generated.select("model", "record", F.lit(True).alias("drawn"))
    artifacts = markup.join(drawn, ["model", "record"], "full").select(
        F.lit(run_time).cast("string").alias("run_time"),
        "model",
        "record",
        "markup",
        F.col("markup").isNotNull().alias("has_markup"),
        F.coalesce("drawn", F.lit(False)).alias("has_render"),
    )
    return artifacts, generated, target


def read_images_packed(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """``image_id`` (the file's path), ``image`` (packed RGB, NULL if unreadable).

    ``names`` is a pattern of file names; other files are not opened.

    The image source yields B, G, R(, alpha) bytes. Alpha is dropped without
    blending, grey is repeated over the channels.
    """
    reader = spark.read.format("image").option("recursiveFileLookup", True)
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    source = reader.load(path)
    raw = source.select("image.*").select("origin", "height", "width", "nChannels", "data")

    def pack(batches):
        for batch in batches:
            columns = ("height", "width", "nChannels", "data")
            images = [_to_rgb(*row) for row in zip(*[batch[c] for c in columns])]
            yield pd.DataFrame({"image_id": batch.origin, "image": images})

    return raw.mapInPandas(pack, PACKED_SCHEMA)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Long pixel table of every readable image under ``path``."""
    return unpack_pixels(read_images_packed(spark, path))


def _to_rgb(height, width, channels, data):
    if height <= 0 or width <= 0:
        return None
    values = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    rgb = values[:, :, 2::-1] if channels >= 3 else np.repeat(values[:, :, :1], 3, axis=2)
    return {"height": height, "width": width, "rgb": rgb.tobytes()}
