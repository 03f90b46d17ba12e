"""Work grid, prompt items, chat messages and dry runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkscore.functions.markup import extract_assets, preview_url, to_data_url
from inkscore.operators.rows import first_n
from inkscore.operators.skew import pair_all

_ITEM = "struct<type:string,text:string,image_url:struct<url:string>>"
_CHAT = "struct<type:string,text:string,image:string>"


def work_grid(examples: DataFrame, models: DataFrame) -> DataFrame:
    """Every example with every chosen model."""
    return pair_all(examples, models)


def _text(value: Column) -> Column:
    link = F.lit(None).cast("struct<url:string>")
    return F.struct(F.lit("text").alias("type"), value.alias("text"), link.alias("image_url")).cast(
        _ITEM
    )


def _image(url: Column) -> Column:
    return F.struct(
        F.lit("image_url").alias("type"),
        F.lit(None).cast("string").alias("text"),
        F.struct(url.alias("url")).alias("image_url"),
    ).cast(_ITEM)


def prompt_items(image: Column, width: Column, height: Column, assets: Column) -> Column:
    """Instruction, main image, then a label and an image per asset, in order."""
    instruction = F.concat(
        F.lit("Write SVG code to recreate this "),
        width.cast("string"),
        F.lit(" x "),
        height.cast("string"),
        F.lit(" px design."),
    )

    def labelled(asset: Column) -> Column:
        label = F.concat(F.lit("Image asset href='"), asset["short"], F.lit("'"))
        return F.array(_text(label), _image(to_data_url(asset["url"])))

    head = F.array(_text(instruction), _image(to_data_url(image)))
    return F.concat(head, F.flatten(F.transform(assets, labelled)))


def build_prompt(examples: DataFrame) -> DataFrame:
    """Add ``prompt`` to ``record, image, width, height, completion`` rows."""
    assets = extract_assets(F.col("completion"))
    return examples.withColumn(
        "prompt", prompt_items(F.col("image"), F.col("width"), F.col("height"), assets)
    )


def explode_assets(df: DataFrame) -> DataFrame:
    """``record, i, short, url``, one row per embedded asset, i from 1."""
    rows = df.select("record", F.posexplode(extract_assets(F.col("completion"))).alias("p", "a"))
    return rows.select("record", (F.col("p") + 1).alias("i"), "a.short", "a.url")


def chat_message(content: Column, role: Column | None = None) -> Column:
    """A message in chat form from one prompt: an array of items or plain text."""
    role = F.lit("user") if role is None else role
    return F.struct(role.alias("role"), content.alias("content"))


def chat_content(items: Column) -> Column:
    """Prompt items with ``image_url`` items re-shaped to ``image`` items."""
    return F.transform(
        items,
        lambda item: F.struct(
            F.when(item["type"] == "image_url", "image").otherwise(item["type"]).alias("type"),
            item["text"].alias("text"),
            item["image_url"]["url"].alias("image"),
        ).cast(_CHAT),
    )


def text_content(text: Column) -> Column:
    """Plain text as the single text item of a message."""
    empty = F.lit(None).cast("string")
    return F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), empty.alias("image")).cast(_CHAT)
    )


def to_chat(prompt: Column) -> Column:
    """A prompt, or a plain text given as text, as a one-message conversation."""
    return F.array(chat_message(chat_content(prompt)))


def conversation_messages(turns: DataFrame) -> DataFrame:
    """Conversation turns as chat messages: ``conv_id, turn, message``.

    One row per turn. The turns of a conversation are not gathered into an
    array here, since one conversation may be of any length.
    """
    message = chat_message(text_content(F.col("text")), F.col("role"))
    return turns.select("conv_id", "turn", message.alias("message"))


def preview_prompts(prompts: DataFrame, n: int = 6) -> DataFrame:
    """Dry run: the first ``n`` prompts as JSON with shortened data URLs."""

    def shorten(item: Column) -> Column:
        url = preview_url(item["image_url"]["url"])
        link = F.when(item["image_url"].isNotNull(), F.struct(url.alias("url")))
        return item.withField("image_url", link)

    return first_n(prompts, n).select(
        "record",
        F.size(extract_assets(F.col("completion"))).alias("assets"),
        F.to_json(F.transform("prompt", shorten)).alias("items"),
    )
