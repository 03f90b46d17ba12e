"""Every operator as a named query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscore.functions.markup import (
    decode_data_url,
    encode_base64,
    extract_assets,
    extract_markup,
    preview_url,
    restore_assets,
    to_data_url,
)
from inkscore.functions.rounding import sig3
from inkscore.functions.text import tokenize_13a
from inkscore.operators import bleu as B
from inkscore.operators import grid as G
from inkscore.operators import images as I
from inkscore.operators import infer as N
from inkscore.operators import pixels as P
from inkscore.operators import prompts as Q
from inkscore.operators import reports as R
from inkscore.operators import rows as W
from inkscore.operators import strips as Z
from inkscore.operators import summary as S
from inkscore.operators.skew import heavy_keys
from inkscore.plans import fixtures as X
from inkscore.plans.scoring import score, score_summary
from inkscore.session import checkpoint_dir, configure
from inkscore.sources import ledger as L
from inkscore.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PICKED = (2, 31, 14, 5, 8, 17, 40, 10_000_000)
IDS = ["gen_id", "tgt_id"]


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounded for comparison, as sums of doubles depend on their order."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.to_artifacts(X.model_outputs(spark, sf_dir), "rendered")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All extracted markup with the target of its record."""
    found = _artifacts(spark, sf_dir)
    targets = X.eval_examples(spark, sf_dir).select("record", "completion")
    # Hot records are looked for on the key alone, before the markup is cut out.
    return G.pair_candidates(found.where(F.col("has_markup")), targets, heavy_keys(found, "record"))


def _bad_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All examples, some without completion and some without width."""
    df = X.eval_examples(spark, sf_dir)
    return df.withColumns(
        {
            "completion": F.when(F.col("record") % 13 == 0, "").otherwise(F.col("completion")),
            "width": F.when(F.col("record") % 17 != 0, F.col("width")),
        }
    )


def _tasks(spark):
    """The small test files are one split each; spread their rows."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# sources, projections, checks


@query
def examples_scan(spark, sf_dir):
    df = W.require_examples(X.eval_examples(spark, sf_dir))
    return df.select("record", "completion", "width", "height")


@query
def raw_one_run(spark, sf_dir):
    rows = W.for_run(X.model_outputs(spark, sf_dir), X.RUNS[1])
    return rows.select("record", "model", "response", "run_time")


@query
def first_n_examples(spark, sf_dir):
    return W.first_n(X.eval_examples(spark, sf_dir)).select("record", "title", "width", "height")


@query
def record_numbering(spark, sf_dir):
    events = X.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return W.with_record(events, ["value", "event_id"])


@query
def validate_rows(spark, sf_dir):
    return W.validate_examples(_bad_examples(spark, sf_dir)).select("record", "error")


@query
def select_models(spark, sf_dir):
    models = X.event_scores(spark, sf_dir)
    return W.select_models(models, ["m_view", "m_click", "m_unknown"]).select("record", "model")


@query
def scores_one_run(spark, sf_dir):
    rows = W.for_run(X.event_scores(spark, sf_dir), "2024-01-15_00-00-00")
    return rows.select("run_time", "record", "model", "bleu", "structural", "pixel")


@query
def successful_rows(spark, sf_dir):
    rows = S.successful(X.event_scores(spark, sf_dir))
    return rows.select("record", "model", "bleu", "structural", "pixel")


@query
def pick_records(spark, sf_dir):
    return W.pick_records(X.eval_examples(spark, sf_dir), PICKED).select("record", "title")


# text and markup


@query
def extract_markup_rows(spark, sf_dir):
    rows = X.model_outputs(spark, sf_dir)
    return rows.select("run_time", "model", "record", extract_markup(F.col("response")).alias("markup"))


@query
def extract_assets_rows(spark, sf_dir):
    assets = extract_assets(F.col("completion"))
    joined = F.transform(assets, lambda a: F.concat(a["short"], F.lit("="), a["url"]))
    return X.eval_examples(spark, sf_dir).select(
        "record", F.size(assets).alias("n"), F.array_join(joined, "|").alias("assets")
    )


@query
def explode_assets(spark, sf_dir):
    return Q.explode_assets(X.eval_examples(spark, sf_dir))


@query
def restore_assets_rows(spark, sf_dir):
    """Answers with their placeholders put back, met with their target."""
    found = X.model_outputs(spark, sf_dir).withColumn("markup", extract_markup(F.col("response")))
    targets = X.eval_examples(spark, sf_dir).select(
        "record", extract_assets(F.col("completion")).alias("assets")
    )
    hot = heavy_keys(found, "record")
    pairs = G.pair_candidates(found.where(F.col("markup").isNotNull()), targets, hot)
    restored = restore_assets(F.col("markup"), F.col("assets"))
    return pairs.select("run_time", "model", "record", restored.alias("markup"))


@query
def to_data_url_rows(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        to_data_url(F.encode("text", "UTF-8"), binary=True).alias("from_bytes"),
        to_data_url(F.md5("text")).alias("from_text"),
        to_data_url(F.concat(F.lit("data:"), F.md5("text"))).alias("from_url"),
    )


@query
def decode_data_url_rows(spark, sf_dir):
    """Bytes put into a data URL and taken out again, as hex."""
    docs = X.table(spark, sf_dir, "documents")
    url = F.concat(F.lit("data:image/png;base64,"), encode_base64(F.encode("text", "UTF-8")))
    return docs.select("doc_id", F.hex(decode_data_url(url)).alias("payload"))


@query
def preview_url_rows(spark, sf_dir):
    examples = X.eval_examples(spark, sf_dir)
    return examples.select(
        "record",
        preview_url(to_data_url(F.col("image"))).alias("preview"),
        preview_url(F.col("image")).alias("unchanged"),
    )


@query
def sig3_rows(spark, sf_dir):
    rows = X.event_scores(spark, sf_dir)
    return rows.select(
        "record",
        *[sig3(F.col(m)).alias(m) for m in G.METRICS],
        sig3(F.col("bleu") * F.col("structural") / 7).alias("product"),
    )


@query
def tokens_13a(spark, sf_dir):
    tokens = tokenize_13a(F.col("html"))
    return X.table(spark, sf_dir, "pages").select(
        "page_id", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("tokens")
    )


@query
def score_bands(spark, sf_dir):
    rows = S.score_bands(X.event_scores(spark, sf_dir))
    return rows.select("record", *[f"{m}_band" for m in G.METRICS])


@query
def metric_disagreement(spark, sf_dir):
    return S.with_disagreement(X.event_scores(spark, sf_dir)).select("record", "disagreement")


# prompts and inference


@query
def work_grid(spark, sf_dir):
    examples = X.eval_examples(spark, sf_dir).select("record", "width", "height")
    models = spark.createDataFrame([(m,) for m in X.MODELS], "model string")
    return Q.work_grid(examples, models)


def _prompts(spark, sf_dir):
    return Q.build_prompt(X.eval_examples(spark, sf_dir))


@query
def prompt_items(spark, sf_dir):
    rows = _prompts(spark, sf_dir).select("record", F.posexplode("prompt").alias("pos", "item"))
    return rows.select(
        "record", "pos", "item.type", "item.text", F.col("item.image_url.url").alias("url")
    )


@query
def to_chat(spark, sf_dir):
    chats = _prompts(spark, sf_dir).select("record", F.inline(Q.to_chat(F.col("prompt"))))
    rows = chats.select("record", "role", F.posexplode("content").alias("pos", "item"))
    return rows.select("record", "role", "pos", "item.type", "item.text", "item.image")


@query
def conversation_messages(spark, sf_dir):
    messages = Q.conversation_messages(X.table(spark, sf_dir, "conversations"))
    rows = messages.select("conv_id", "turn", "message.role", F.inline("message.content"))
    return rows.select("conv_id", "turn", "role", "type", "text")


@query
def prompt_preview(spark, sf_dir):
    return Q.preview_prompts(_prompts(spark, sf_dir))


def _stub(row):
    if row["record"] % 5 == 0:
        raise ValueError(f"no answer for {row['record']}")
    return f"{row['model']}: {row['prompt'][0]['text']}"


@query
def infer_stub(spark, sf_dir):
    models = spark.createDataFrame([(m,) for m in X.MODELS], "model string")
    checked = W.validate_examples(_bad_examples(spark, sf_dir))
    work = Q.work_grid(Q.build_prompt(checked), models)
    answers = N.infer(work.select("record", "model", "prompt", "error"), _stub)
    return N.with_response(answers).select("record", "model", "response", "error")


def _half(prompts):
    """Answers every prompt of the first records only: what a broken attempt leaves."""
    return N.infer(prompts.where(F.col("record") % 2 == 0), _stub)


@query
def resumed_responses(spark, sf_dir):
    """A run whose first attempt left half of its answers out, and its repetition."""
    models = spark.createDataFrame([(m,) for m in X.MODELS], "model string")
    checked = W.validate_examples(_bad_examples(spark, sf_dir))
    work = Q.work_grid(Q.build_prompt(checked), models).select("record", "model", "prompt", "error")
    path = f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    L.record_responses(work, _half, path, X.RUNS[0], parts=3)
    L.record_responses(work, lambda rows: N.infer(rows, _stub), path, X.RUNS[0], parts=3)
    answers = N.with_response(L.read_ledger(spark, path, X.RUNS[0]))
    return answers.select("run_time", "record", "model", "response", "error")


@query
def artifacts(spark, sf_dir):
    return _artifacts(spark, sf_dir)


# joins


@query
def candidate_pairs(spark, sf_dir):
    return _candidates(spark, sf_dir).select("run_time", "model", "record", "markup", "completion")


@query
def complete_grid(spark, sf_dir):
    scores = X.event_scores(spark, sf_dir)
    return G.complete_grid(scores, scores.select("model").distinct(), scores)


@query
def missing_targets(spark, sf_dir):
    """Images wanted by a pair list against the pages that could be targets."""
    wanted = X.image_pairs(spark, sf_dir).select(F.col("gen_id").alias("record"))
    return W.missing_targets(wanted, X.eval_examples(spark, sf_dir))


@query
def missing_artifacts(spark, sf_dir):
    examples = X.eval_examples(spark, sf_dir)
    rows = G.missing_artifacts(_artifacts(spark, sf_dir), X.model_groups(spark), examples)
    return rows.withColumn("missing", F.array_join("missing", ","))


@query
def bucketed_pairs(spark, sf_dir):
    """The pairs of candidate_pairs, from tables in buckets by record."""
    name = uuid.uuid4().hex
    path = f"{checkpoint_dir(spark)}/buckets-{name}"
    found = _artifacts(spark, sf_dir).where("has_markup").drop("response")
    targets = X.eval_examples(spark, sf_dir).select("record", "completion")
    ours = T.write_bucketed(found, f"artifacts_{name}", f"{path}/artifacts", 8)
    theirs = T.write_bucketed(targets, f"examples_{name}", f"{path}/examples", 8)
    rows = G.pair_bucketed(ours, theirs)
    return rows.select("run_time", "model", "record", "markup", "completion")


@query
def artifact_coverage(spark, sf_dir):
    examples = X.eval_examples(spark, sf_dir)
    return G.artifact_coverage(_artifacts(spark, sf_dir), X.model_groups(spark), examples)


# metrics


@query
def ngram_counts(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages")
    return B.ngram_counts(pages, ["page_id"], "html", partitions=_tasks(spark))


@query
def ngram_precision(spark, sf_dir):
    rows = B.ngram_precision(X.page_pairs(spark, sf_dir), ["pair_id"])
    return _round(rows, "precision", digits=9)


@query
def bleu_pages(spark, sf_dir):
    rows = B.bleu(X.page_pairs(spark, sf_dir), ["pair_id"], partitions=_tasks(spark))
    return _round(rows, "bleu", digits=9)


@query
def bleu_documents(spark, sf_dir):
    rows = B.bleu(X.document_pairs(spark, sf_dir), ["pair_id"], partitions=_tasks(spark))
    return _round(rows, "bleu", digits=9)


@query
def bleu_documents_grams(spark, sf_dir):
    rows = B.bleu(X.document_pairs(spark, sf_dir), ["pair_id"], method="grams")
    return _round(rows, "bleu", digits=9)


OUTPUT_KEYS = ["run_time", "model", "record"]


def _output_bleu(spark, sf_dir):
    """All extracted markup against its target, whose tokens are made once for all of its candidates."""
    found = _artifacts(spark, sf_dir)
    ours = found.where(F.col("has_markup")).select(*OUTPUT_KEYS, "markup")
    targets = X.eval_examples(spark, sf_dir).select("record", "completion")
    pairs = G.pair_candidates(
        B.counted_tokens(ours, "markup"), B.counted_tokens(targets, "completion"), heavy_keys(found, "record")
    )
    # The pairs are scored where they meet: each holds its target, which would move once a candidate.
    return B.bleu(pairs, OUTPUT_KEYS, "markup", "completion", counted=True)


@query
def bleu_outputs(spark, sf_dir):
    return _round(_output_bleu(spark, sf_dir), "bleu", digits=9)


@query
def bleu_leaderboard(spark, sf_dir):
    """Mean BLEU per model over all its markup, best first."""
    means = _output_bleu(spark, sf_dir).groupBy("model").agg(
        F.round(F.avg("bleu"), 6).alias("bleu"), F.count("*").alias("count")
    )
    return means.orderBy(F.desc("bleu"), "model")


def _side(spark, sf_dir):
    pixels = X.image_pixels(spark, sf_dir)
    return P.pair_pixels(pixels, pixels, X.image_pairs(spark, sf_dir))


@query
def pixel_wrap(spark, sf_dir):
    return _round(P.pixel_similarity(_side(spark, sf_dir), IDS, "wrap"), "pixel", digits=9)


@query
def pixel_abs(spark, sf_dir):
    return _round(P.pixel_similarity(_side(spark, sf_dir), IDS, "abs"), "pixel", digits=9)


@query
def ssim(spark, sf_dir):
    return _round(P.ssim(_side(spark, sf_dir), IDS), "structural")


@query
def lanczos_resample(spark, sf_dir):
    pixels = X.tiled_pixels(spark, sf_dir)
    size = F.lit(X.SIDE)
    sizes = P.image_sizes(pixels).select("*", size.alias("out_w"), size.alias("out_h"))
    return P.resample_to(pixels, sizes)


@query
def image_similarity(spark, sf_dir):
    pixels = X.image_pixels(spark, sf_dir, ragged=True)
    rows = P.image_similarity(pixels, pixels, X.image_pairs(spark, sf_dir))
    return _round(rows, "structural", "pixel")


def _packed_pairs(spark, sf_dir, ragged):
    images = X.packed_images(spark, sf_dir, ragged)
    gen = images.select(F.col("image_id").alias("gen_id"), F.col("image").alias("gen"))
    tgt = images.select(F.col("image_id").alias("tgt_id"), F.col("image").alias("tgt"))
    return X.image_pairs(spark, sf_dir).join(gen, "gen_id").join(tgt, "tgt_id")


@query
def image_similarity_packed(spark, sf_dir):
    rows = I.image_similarity_packed(_packed_pairs(spark, sf_dir, True), IDS)
    return _round(rows, "structural", "pixel")


@query
def strip_similarity(spark, sf_dir):
    """Large images, each with the next one; every other pair is resampled first."""
    strips = X.large_strips(spark, sf_dir)
    ids = strips.select(F.col("image_id").alias("gen_id")).distinct()
    known = ids.select(F.col("gen_id").alias("tgt_id"))
    pairs = ids.withColumn("tgt_id", F.col("gen_id") + 1).join(known, "tgt_id")
    rows = Z.strip_similarity(strips, strips, pairs, strip_bytes=1 << 18)
    return _round(rows.select("gen_id", "tgt_id", "structural", "pixel"), "structural", "pixel")


@query
def unpack_pixels(spark, sf_dir):
    return I.unpack_pixels(X.packed_images(spark, sf_dir, ragged=True))


def _scores(spark, sf_dir):
    images = X.packed_images(spark, sf_dir, ragged=True)
    gen = images.select(F.col("image_id").alias("record"), "image")
    tgt = images.select((F.col("image_id") - 1).alias("record"), "image")
    candidates, targets = _artifacts(spark, sf_dir), X.eval_examples(spark, sf_dir)
    return score(candidates, targets, gen, tgt, partitions=_tasks(spark))


@query
def scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query
def scores_summary(spark, sf_dir):
    return score_summary(_scores(spark, sf_dir))


# aggregations


def _rounded_scores(spark, sf_dir):
    return S.round_scores(X.event_scores(spark, sf_dir))


@query
def mean_scores(spark, sf_dir):
    return _round(S.mean_scores(_rounded_scores(spark, sf_dir)), *G.METRICS)


@query
def successful_means(spark, sf_dir):
    rows = S.successful_means(_rounded_scores(spark, sf_dir))
    return _round(rows, *[f"{m}_successful" for m in G.METRICS])


@query
def failure_type(spark, sf_dir):
    return S.with_failure_type(X.event_scores(spark, sf_dir)).select("record", "model", "failure")


@query
def failure_counts(spark, sf_dir):
    return S.failure_counts(X.event_scores(spark, sf_dir))


@query
def failure_totals(spark, sf_dir):
    return S.failure_totals(X.event_scores(spark, sf_dir))


@query
def distinct_models(spark, sf_dir):
    return X.event_scores(spark, sf_dir).select("model").distinct()


@query
def incomplete_models(spark, sf_dir):
    """Days on which a model has not exactly 67 rows."""
    return S.incomplete_models(X.event_scores(spark, sf_dir), 67, ("run_time", "model"))


@query
def success_rate(spark, sf_dir):
    return _round(S.success_rate(X.event_scores(spark, sf_dir)), "success_percent")


@query
def summary(spark, sf_dir):
    return S.summarize(_rounded_scores(spark, sf_dir))


@query
def summary_by_run(spark, sf_dir):
    return S.summarize(_rounded_scores(spark, sf_dir), ("run_time", "model"))


def _kept_state(spark, sf_dir):
    """The state after two updates of some runs each, and one that was made twice."""
    scores = _rounded_scores(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/summary-{uuid.uuid4().hex}"
    early = F.col("run_time") < "2024-01-15_00-00-00"
    T.update_summary_state(scores.where(~early), path)
    T.update_summary_state(scores.where(early), path)
    T.update_summary_state(scores.where(early), path)
    return T.read_summary_state(spark, path)


@query
def kept_summary(spark, sf_dir):
    return S.summary_of_state(_kept_state(spark, sf_dir))


@query
def kept_summary_by_run(spark, sf_dir):
    return S.summary_of_state(_kept_state(spark, sf_dir), ("run_time", "model"))


# reports


@query
def leaderboard(spark, sf_dir):
    return S.leaderboard(S.summarize(_rounded_scores(spark, sf_dir)), "bleu")


@query
def chart_table(spark, sf_dir):
    return R.chart_table(S.summarize(_rounded_scores(spark, sf_dir)))


@query
def leaderboard_by_run(spark, sf_dir):
    return S.leaderboard(S.summarize(_rounded_scores(spark, sf_dir), ("run_time", "model")), "bleu")


@query
def chart_table_by_run(spark, sf_dir):
    return R.chart_table(S.summarize(_rounded_scores(spark, sf_dir), ("run_time", "model")))


def _manifest(spark, sf_dir):
    examples = X.eval_examples(spark, sf_dir)
    found = W.for_run(_artifacts(spark, sf_dir), X.RUNS[0])
    return R.comparison_manifest(examples, X.MODELS, found, PICKED, 280, 320)


@query
def comparison_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query
def comparison_pivot(spark, sf_dir):
    return R.comparison_pivot(_manifest(spark, sf_dir), X.MODELS)


@query
def grid_layout(spark, sf_dir):
    return R.grid_layout(X.eval_examples(spark, sf_dir), 280, 320)
