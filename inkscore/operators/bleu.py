"""N-gram tables, clipped precision and BLEU of text pairs.

Matches of a pair are counted where its two texts are: see :func:`clipped_matches`.
One exchange on the pair key, made while the rows still are whole texts, carries
the grouped form; no gram is ever shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkscore.functions.text import tokenize_13a

_END = 2**31 - 1
# Stand between candidates and between references of one group. No token of a text holds a tab.
MARKS = ("\t<", "\t>")


def _given(df: DataFrame, name: str) -> bool:
    """Whether a column holds tokens already."""
    return isinstance(df.schema[name].dataType, T.ArrayType)


def _sent(df: DataFrame, name: str, tokens: str) -> Column:
    """Tokens as Python gets them: in one string, but a given array may hold anything
    and goes as it is."""
    return F.col(tokens) if _given(df, name) else F.array_join(tokens, " ")


def _tokens(df: DataFrame, name: str) -> Column:
    """Tokens of a text column; an array column is taken as tokens already.

    A missing text has no tokens.
    """
    column = F.col(name)
    if not _given(df, name):
        column = tokenize_13a(column)
    return F.coalesce(column, F.array().cast("array<string>"))


def counted_tokens(df: DataFrame, text: str) -> DataFrame:
    """``df`` whose text is its tokens with a space between two, and ``<text>_n``, their number.

    For texts that many pairs share: made before they are paired, tokens are made once.
    """
    rest = [c for c in df.columns if c != text]
    tokens = df.select(*rest, _tokens(df, text).alias("_tokens"))
    return tokens.select(*rest, F.array_join("_tokens", " ").alias(text), F.size("_tokens").alias(f"{text}_n"))


def _windows(tokens: Column, max_n: int, sign: int) -> Column:
    # array_repeat and slice share the order of the tokens; arrays_zip pads the
    # windows at the end of the text with NULL.
    shifted = [F.slice(tokens, n + 1, _END).alias(f"t{n + 1}") for n in range(max_n)]
    signs = F.array_repeat(F.lit(sign), F.size(tokens)).alias("b")
    return F.arrays_zip(*shifted, signs)


def ngrams(df: DataFrame, keys: Sequence[str], text: str, max_n: int = 4) -> DataFrame:
    """Every n-gram occurrence, n = 1..max_n: ``keys, n, gram``.

    Tokens hold no spaces, so the grams joined by one space stay distinct.
    """
    tokens = df.select(*keys, _tokens(df, text).alias("tokens"))
    windows = tokens.select(*keys, F.explode(_windows(F.col("tokens"), max_n, 1)).alias("w"))
    parts = [F.col("w")[f] for f in windows.schema["w"].dataType.names[:max_n]]
    # Short windows at the end of a text give NULL for the longer grams.
    grams = [parts[0]]
    for part in parts[1:]:
        grams.append(F.concat(grams[-1], F.lit(" "), part))
    rows = windows.select(*keys, F.posexplode(F.array(*grams)).alias("i", "gram"))
    return rows.where(F.col("gram").isNotNull()).select(
        *keys, (F.col("i") + 1).alias("n"), "gram"
    )


def ngram_counts(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    max_n: int = 4,
    partitions: int | None = None,
) -> DataFrame:
    """``keys, n, gram, count``.

    Counts are combined before they are shuffled, which holds for any ``keys``.
    Where ``keys`` tell single texts apart, ``partitions`` spreads the texts by
    them instead, and no gram is shuffled at all.
    """
    if partitions:
        df = df.select(*keys, text).repartition(partitions, *keys)
    return ngrams(df, keys, text, max_n).groupBy(*keys, "n", "gram").agg(
        F.count("*").alias("count")
    )


def _put_together(side: Column, given: bool, mark: str) -> Column:
    """One list of the tokens of all texts in a list of them, with a mark between two."""
    if given:
        marked = F.transform(side, lambda t, i: F.when(i > 0, F.concat(F.array(F.lit(mark)), t)).otherwise(t))
        return F.flatten(marked)
    return F.array_join(side, f" {mark} ")


def _matches(
    pairs: DataFrame, keys: Sequence[str], cand: str, ref: str, max_n: int, partitions: int | None
) -> DataFrame:
    """``keys, len_c, len_r, m1..m<max_n>``: clipped matches of every order.

    Pairs of equal keys and lengths make one row: their grams are counted as one group.
    The texts cross one exchange; their grams are counted in the Arrow batches of a task
    and are never rows.
    """
    keys = list(keys)
    # A stated number of partitions is kept; one left open would be cut down to
    # the size of the texts, of which the grams are many times as large.
    partitions = partitions or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = pairs.select(*keys, cand, ref).repartition(partitions, *keys)
    tokens = texts.select(*keys, _tokens(pairs, cand).alias("c"), _tokens(pairs, ref).alias("r"))
    sent = tokens.select(
        *keys,
        F.size("c").alias("len_c"),
        F.size("r").alias("len_r"),
        _sent(pairs, cand, "c").alias("c"),
        _sent(pairs, ref, "r").alias("r"),
    )
    fixed = [*keys, "len_c", "len_r"]
    groups = sent.groupBy(*fixed).agg(
        F.count("*").alias("_pairs"), F.collect_list("c").alias("c"), F.collect_list("r").alias("r")
    )
    # No gram reaches over the end of a text: a mark stands on one side only.
    sides = [
        _put_together(F.when(F.col(f"len_{x}") > 0, F.col(x)).otherwise(F.slice(x, 1, 1)), _given(pairs, name), mark)
        for x, name, mark in (("c", cand, MARKS[0]), ("r", ref, MARKS[1]))
    ]

    @F.arrow_udf("array<bigint>")
    def clipped(ours: pa.Array, theirs: pa.Array) -> pa.Array:
        found = [clipped_matches(a, b, max_n)[2] for a, b in _portions(ours, theirs)]
        values = np.concatenate(found, axis=1).T.ravel() if found else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(ours) + 1) * max_n, pa.int32()), pa.array(values, pa.int64()))

    counted = groups.select(*fixed, "_pairs", clipped(*sides).alias("_found"))

    def matched(n: int) -> Column:
        total = possible(F.col("len_c"), n) + possible(F.col("len_r"), n)
        # The total is that of one pair: where several make a row, the rest counts against the matches.
        return (F.col("_found")[n - 1] + F.shiftright(total * (1 - F.col("_pairs")), 1)).alias(f"m{n}")

    return counted.select(*fixed, *[matched(n) for n in range(1, max_n + 1)])


def possible(length: Column, n: int) -> Column:
    """How many n-grams a text of ``length`` tokens has."""
    return F.greatest(length - (n - 1), F.lit(0))


def ngram_precision(
    pairs: DataFrame,
    keys: Sequence[str],
    cand: str = "cand",
    ref: str = "ref",
    max_n: int = 4,
    partitions: int | None = None,
) -> DataFrame:
    """Clipped precision per order: ``keys, n, matched, possible, precision``."""
    wide = _matches(pairs, keys, cand, ref, max_n, partitions)
    orders = F.array(
        *[
            F.struct(
                F.lit(n).alias("n"),
                F.col(f"m{n}").alias("matched"),
                possible(F.col("len_c"), n).alias("possible"),
            )
            for n in range(1, max_n + 1)
        ]
    )
    rows = wide.select(*keys, F.inline(orders))
    share = F.when(F.col("possible") > 0, F.col("matched") / F.col("possible")).otherwise(0.0)
    return rows.withColumn("precision", share)


def bleu(
    pairs: DataFrame,
    keys: Sequence[str],
    cand: str = "cand",
    ref: str = "ref",
    max_n: int = 4,
    partitions: int | None = None,
    method: str = "rows",
    counted: bool = False,
) -> DataFrame:
    """Unsmoothed BLEU of every pair: ``keys, len_c, len_r, bleu``.

    ``keys`` must tell the pairs apart. ``cand`` and ``ref`` are texts or token
    arrays, or both as of :func:`counted_tokens` (``counted``, for rows). A pair with
    an empty side scores 0.

    ``method="rows"`` counts inside each row in Arrow batches: the texts stay
    where the join left them (or are spread over ``partitions`` tasks) and a task
    holds one batch of pairs at a time. ``method="grams"`` is the same score of the clipped
    matches of each order, with pairs grouped by their keys first; the formula is columns.
    """
    if method == "rows":
        if partitions:
            pairs = pairs.repartition(partitions, *keys)
        return _bleu_rows(pairs, keys, cand, ref, max_n, counted)
    if counted:
        raise ValueError("counted tokens are for method rows")
    wide = _matches(pairs, keys, cand, ref, max_n, partitions)
    shares = [
        F.when(F.col(f"m{n}") > 0, F.col(f"m{n}") / possible(F.col("len_c"), n))
        for n in range(1, max_n + 1)
    ]
    logs = sum((F.ln(share) for share in shares[1:]), F.ln(shares[0]))
    penalty = F.when(F.col("len_c") > F.col("len_r"), 1.0).otherwise(
        F.exp(1 - F.col("len_r") / F.col("len_c"))
    )
    # A missing share is NULL and makes the whole product NULL.
    score = F.when((F.col("len_c") > 0) & (F.col("len_r") > 0), F.exp(logs / max_n) * penalty)
    return wide.select(*keys, "len_c", "len_r", F.coalesce(score, F.lit(0.0)).alias("bleu"))


STEP, HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)
# Tokens of both sides that are counted together in a task.
TOKENS_AT_ONCE = 250_000


def _mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _token_lists(side: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of a batch, and the number in each row."""
    given = pa.types.is_list(side.type) or pa.types.is_large_list(side.type)
    # Tokens made from a text hold no space, so one string carries them.
    lists = side if given else pc.split_pattern(side, " ")
    values, lengths = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    if not given:
        # A text without tokens is split into an empty one.
        values = values.filter(pc.not_equal(values, ""))
        lengths[pc.equal(pc.fill_null(side, ""), "").to_numpy(zero_copy_only=False)] = 0
    return values, lengths


def clipped_matches(cand: pa.Array, ref: pa.Array, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each candidate and reference, and (max_n, rows) clipped n-gram matches.

    A gram is told by its row and token, a longer one by the numbers of the two grams
    that it begins and ends with. Equal ones are brought together by one sort of hashes an
    order and numbered, and only those that stand on both sides go on to the next order.
    Neighbours are compared by what tells them, so a collision that makes a
    match is seen, and the rows it touches are counted by the grams themselves.
    """
    (c_values, c_n), (r_values, r_n) = _token_lists(cand), _token_lists(ref)
    rows = len(c_n)
    encoded = pa.concat_arrays([c_values.cast(pa.string()), r_values.cast(pa.string())]).dictionary_encode()
    # NULL tokens are alike.
    token = encoded.indices.fill_null(len(encoded.dictionary)).to_numpy().astype(np.uint64)
    lengths = np.concatenate([c_n, r_n])
    row = np.repeat(np.tile(np.arange(rows), 2), lengths)
    n_ours = c_n.sum()
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(token))
    matches = np.zeros((max_n, rows), np.int64)
    suspect: set[int] = set()
    # The low bits of a sorted hash say where its gram is.
    places = np.uint64((1 << max(1, len(token).bit_length())) - 1)
    at = np.arange(len(token))
    told = row.astype(np.uint64) << HALF | token
    for n in range(1, max_n + 1):
        if not len(at):
            break
        hashes = np.sort(_mix(told[at] * STEP) & ~places | at.astype(np.uint64))
        at = (hashes & places).astype(np.int64)
        hashes &= ~places
        new = np.append(True, hashes[1:] != hashes[:-1])
        sorted_ = told[at]
        unlike = np.flatnonzero((sorted_[1:] != sorted_[:-1]) & ~new[1:])
        if len(unlike):
            suspect.update(row[at[unlike]].tolist(), row[at[unlike + 1]].tolist())
        first = np.flatnonzero(new)
        counts = np.diff(first, append=len(at))
        of_ours = np.add.reduceat(at < n_ours, first, dtype=np.int64)
        least = np.minimum(of_ours, counts - of_ours)
        both = least > 0
        matches[n - 1] = np.bincount(row[at[first[both]]], weights=least[both], minlength=rows)
        # Only what stands on both sides is looked at again, and can be longer there.
        numbers = np.zeros(len(token) + 1, np.uint64)
        numbers[at] = np.repeat(np.where(both, np.cumsum(both), 0), counts)
        at = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0) & (room > n))
        told = numbers[:-1] << HALF | numbers[1:]
    if suspect:
        split = np.split(token, np.cumsum(lengths)[:-1])
        for i in suspect:
            matches[:, i] = _slow_matches(split[i].tolist(), split[rows + i].tolist(), max_n)
    return c_n, r_n, matches


def _slow_matches(cand: list, ref: list, max_n: int) -> list[int]:
    counts = []
    for n in range(1, max_n + 1):
        ours, theirs = (Counter(zip(*(side[i:] for i in range(n)))) for side in (cand, ref))
        counts.append((ours & theirs).total())
    return counts


def _scores(cand: pa.Array, ref: pa.Array, max_n: int) -> np.ndarray:
    c_n, r_n, matches = clipped_matches(cand, ref, max_n)
    logs = np.zeros(len(c_n))
    with np.errstate(divide="ignore", invalid="ignore"):
        for n, matched in enumerate(matches):
            logs += np.log(matched / (c_n - n))
        penalty = np.where(c_n > r_n, 1.0, np.exp(1 - r_n / c_n))
        score = np.exp(logs / max_n) * penalty
    return np.where((matches > 0).all(axis=0), score, 0.0)


def _sizes(side: pa.Array) -> np.ndarray:
    """About as many tokens as each row has, at least."""
    if pa.types.is_list(side.type) or pa.types.is_large_list(side.type):
        return side.value_lengths().fill_null(0).to_numpy()
    return pc.binary_length(side).fill_null(0).to_numpy() // 3


def _portions(ours: pa.Array, theirs: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Both sides in slices of about as many tokens as are counted at once."""
    ends = np.cumsum(1 + _sizes(ours) + _sizes(theirs))
    edges = np.searchsorted(ends, np.arange(TOKENS_AT_ONCE, ends[-1] if len(ends) else 0, TOKENS_AT_ONCE))
    edges = np.unique(np.concatenate([[0], edges, [len(ends)]])).tolist()
    for a, b in zip(edges, edges[1:]):
        yield ours.slice(a, b - a), theirs.slice(a, b - a)


def _bleu_rows(
    pairs: DataFrame, keys: Sequence[str], cand: str, ref: str, max_n: int, counted: bool = False
) -> DataFrame:
    @F.arrow_udf("double")
    def score(ours: pa.Array, theirs: pa.Array) -> pa.Array:
        found = [_scores(a, b, max_n) for a, b in _portions(ours, theirs)]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    if counted:
        lengths = [F.col(f"{name}_n").alias(f"len_{x}") for name, x in ((cand, "c"), (ref, "r"))]
        return pairs.select(*keys, *lengths, score(cand, ref).alias("bleu"))
    tokens = pairs.select(
        *keys, _tokens(pairs, cand).alias("c"), _tokens(pairs, ref).alias("r")
    )
    return tokens.select(
        *keys,
        F.size("c").alias("len_c"),
        F.size("r").alias("len_r"),
        score(_sent(pairs, cand, "c"), _sent(pairs, ref, "r")).alias("bleu"),
    )
