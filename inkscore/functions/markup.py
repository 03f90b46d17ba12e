"""Markup and asset-URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkscore.functions.text import once

# The formats prompts and placeholders are written in.
ASSET_PATTERN = "data:image[^\"']*"
PNG_PREFIX = "data:image/png;base64,"


def extract_markup(text: Column, tag: str = "svg") -> Column:
    """First ``<tag ... </tag>`` of a free text, shortest match; NULL if none.

    Two searches for fixed strings: what follows the first opening closes it, if anything does.
    """
    opening, closing = f"<{tag}", f"</{tag}>"

    def found(known: Column) -> Column:
        start = F.position(F.lit(opening), known)
        end = F.position(F.lit(closing), known, start + len(opening))
        return F.when((start > 0) & (end > 0), F.substring(known, start, end - start + len(closing)))

    return once(text, found)


def extract_assets(markup: Column) -> Column:
    """Embedded data URLs in order, each with its ``cdn://<i>.jpg`` name.

    Repeated URLs stay separate entries. array<struct<short, url>>.
    """
    urls = F.regexp_extract_all(markup, F.lit(ASSET_PATTERN), F.lit(0))
    return F.transform(
        urls,
        lambda url, i: F.struct(
            F.concat(F.lit("cdn://"), (i + 1).cast("string"), F.lit(".jpg")).alias("short"),
            url.alias("url"),
        ),
    )


def restore_assets(markup: Column, assets: Column) -> Column:
    """Put the data URLs back, one entry after the other in array order."""
    return F.aggregate(
        assets, markup, lambda text, asset: F.replace(text, asset["short"], asset["url"])
    )


def encode_base64(data: Column) -> Column:
    """Base64 of binary on one line (Spark's own output is broken into lines)."""
    return F.translate(F.base64(data), "\r\n", "")


def to_data_url(image: Column, binary: bool = False) -> Column:
    """A ``data:`` URL from base64 text, a data URL, or (``binary``) PNG bytes."""
    text = encode_base64(image) if binary else image
    return F.when(text.startswith("data:"), text).otherwise(F.concat(F.lit(PNG_PREFIX), text))


def decode_data_url(url: Column) -> Column:
    """Bytes of a base64 data URL; NULL where the payload is no base64."""
    return F.try_to_binary(F.get(F.split(url, ","), F.lit(1)), F.lit("base64"))


def preview_url(url: Column) -> Column:
    """Data URLs shortened for display, anything else unchanged."""
    short = F.concat(F.substring(url, 1, 30), F.lit("..."), F.right(url, F.lit(10)))
    return F.when(url.startswith("data:"), short).otherwise(url)
