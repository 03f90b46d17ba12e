"""Score every candidate: code overlap, structural and pixel similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkscore.functions.markup import extract_assets, restore_assets
from inkscore.functions.text import tokenize_13a
from inkscore.operators.bleu import bleu
from inkscore.operators.grid import METRICS, complete_grid, pair_candidates
from inkscore.operators.images import image_similarity_packed
from inkscore.operators.rows import require_unique
from inkscore.operators.skew import heavy_keys, salted_join
from inkscore.operators.summary import round_scores, summarize


def score(
    artifacts: DataFrame,
    examples: DataFrame,
    gen_images: DataFrame,
    tgt_images: DataFrame,
    restore: bool = False,
    mode: str = "wrap",
    bleu_method: str = "rows",
    partitions: int | None = None,
    check_unique: bool = False,
) -> DataFrame:
    """Score rows of every (run, model) present and every record of ``examples``.

    ``artifacts``: run_time, model, record, markup, has_markup, has_render, with
    one row per (run_time, model, record); ``check_unique`` makes sure of that at
    the cost of a pass over the keys. ``gen_images``: packed ``image`` by
    record and, where the drawings differ, by model and run_time as well.
    ``tgt_images``: record, packed ``image``.

    Result: run_time, model, record, has_markup, has_render, bleu, structural,
    pixel. A missing markup or drawing, or a text without any token, zeroes all
    three scores; a failed image comparison zeroes only the two image scores.
    The scores are rounded to three significant figures.
    """
    keys = ["run_time", "model", "record"]
    if check_unique:
        require_unique(artifacts, keys)
    flags = ["has_markup", "has_render"]
    hot = heavy_keys(artifacts, "record")
    usable = F.col("has_markup") & F.col("has_render")
    candidates = artifacts.select(*keys, *flags, F.when(usable, F.col("markup")).alias("markup"))

    # Tokens of a target are made once, before it meets its many candidates.
    completion = F.col("completion")
    target = examples.select(
        "record",
        tokenize_13a(completion).alias("ref"),
        *([extract_assets(completion).alias("assets")] if restore else []),
    )
    texts = pair_candidates(candidates, target, hot)
    if restore:
        texts = texts.withColumn("markup", restore_assets(F.col("markup"), F.col("assets")))
    code = bleu(texts, [*keys, *flags], "markup", "ref", partitions=partitions, method=bleu_method)

    # Image bytes move once, to meet their target; the rest joins narrow rows.
    shared = [k for k in keys if k in gen_images.columns]
    ours = gen_images.select(*shared, F.col("image").alias("gen"))
    theirs = tgt_images.select("record", F.col("image").alias("tgt"))
    if shared == ["record"]:
        looks = image_similarity_packed(ours.join(theirs, "record"), shared, mode)
        scored = salted_join(code, looks, "record", ["run_time", "model"], "left", hot)
    else:
        looks = image_similarity_packed(pair_candidates(ours, theirs, hot), shared, mode)
        scored = code.join(looks, shared, "left")

    # Without tokens on either side there is no score at all.
    complete = (F.col("len_c") > 0) & (F.col("len_r") > 0)
    scored = scored.withColumns({m: F.when(complete, F.col(m)) for m in METRICS})
    groups = artifacts.select("run_time", "model").distinct()
    full = complete_grid(scored, groups, examples, flags=flags)
    return round_scores(full.select(*keys, *flags, *METRICS))


def score_summary(scores: DataFrame, by_run: bool = True) -> DataFrame:
    """Summary of :func:`score` rows, per model and, if wanted, per run."""
    return summarize(scores, ("run_time", "model") if by_run else ("model",))
