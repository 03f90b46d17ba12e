"""Language-model scores from a log-frequency Bloom filter.

Counts of n-grams are quantised: level j stands for ``least * 2^(j-1)`` or more.
The filter holds each n-gram once for every level up to its own, so the level is
read back by probing for 1, 2, ... until a probe fails. Probabilities of n-grams
are interpolated with those of shorter ones, with the share of the training tokens
whose n-gram would be held without them (leaving one out) as the weight; those of
single words, which the base score shows as well, use exact counts.

The corpus is dealt into shards of whole documents. A shard sends the hashes and
counts of its n-grams to buckets of hashes, which sum them over all shards; a
bucket of longer n-grams becomes its block of the filter, a bucket of words
answers every shard with the exact counts of the shard's own words. A filter
that is sure to be small is broadcast. Of a larger one no task holds more than a
block: shards also send the n-grams they only ask for, and the bucket answers
with the levels at which its block holds them. So the texts are read twice,
whatever the size of the filter; the number of shards and buckets grows with the
corpus, the size of each does not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MASK64, WORD_HASHES, fold, mix, settle, text_bytes

FOLDS, HELD_OUT = 7, 2
ORDER = 2
LEAST_COUNT = 2
BITS_PER_ITEM = 10
PROBES = 6
SHARD_BYTES = 8_000_000
SLICE_BYTES = 64_000_000
# Tokens of a shard that are looked up and scored together.
TOKENS_AT_ONCE = 100_000
BEGIN, END = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
STEP = np.uint64(0xE7037ED1A0B428DB)
LEVEL = 0x8EBC6AF09C88C6E3
# N-grams keep 48 bits of their hash, which errs far less often than the filter.
TAIL = np.uint64(0xFFFF)
WORDS, REPLY, BITS = 1, -1, -2


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, joined, and the number of each; an end after each."""
    found, counts = [], []
    end = np.array([END])
    for text in texts:
        own = WORD_HASHES.of(text.lower().split())
        found += [own, end]
        counts.append(len(own) + 1)
    joined = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return joined, np.array(counts, np.int64)


def grams_of(tokens: np.ndarray, counts: np.ndarray, order: int) -> Iterator[tuple]:
    """(n, hashes, where) for n = 2 .. order: the n-gram that ends at each token,
    and whether it is whole; a begin mark stands before each text."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    ending = tokens
    for n in range(2, order + 1):
        before = np.empty_like(ending)
        before[1:] = ending[:-1]
        before[place == 0] = BEGIN
        ending = mix(before * STEP + tokens) & ~TAIL
        yield n, ending, place >= n - 2


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    bits = buckets.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the largest needs; the first byte says how many."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widen(data: bytes) -> np.ndarray:
    out = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    return out.reshape(-1).view("<u8")


def _shorten(hashes: np.ndarray, bucket: int, buckets: int) -> bytes:
    """The upper 48 bits of a bucket's hashes, in order, as the steps from one to the next."""
    start = np.uint64(bucket * (1 << 48) // buckets)
    return _narrow(np.diff(hashes >> np.uint64(16), prepend=start))


def _lengthen(data: bytes, bucket: int, buckets: int) -> np.ndarray:
    start = np.uint64(bucket * (1 << 48) // buckets)
    return (np.cumsum(_widen(data), dtype=np.uint64) + start) << np.uint64(16)


def level_of(counts: np.ndarray, least: int) -> np.ndarray:
    """1 for ``least`` to twice that, and so on; 0 below."""
    levels = np.zeros(len(counts), np.int64)
    enough = counts >= least
    levels[enough] = 1 + np.floor(np.log2(counts[enough] / least)).astype(np.int64)
    return levels


def _places(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash at a level: the first probe and the step to the next, before the remainder."""
    first = mix(hashes + np.uint64(level * LEVEL & MASK64))
    return first, (first >> np.uint64(32)) | np.uint64(1)


def make_block(hashes: np.ndarray, levels: np.ndarray) -> bytes:
    """The bits of a bucket's n-grams, each held at levels 1 to its own."""
    items = int(levels.sum())
    bits = np.zeros(max(64, -(-items * BITS_PER_ITEM // 64) * 64), bool)
    size = np.uint64(len(bits))
    for level in range(1, int(levels.max(initial=0)) + 1):
        place, step = _places(hashes[levels >= level], level)
        for _ in range(PROBES):
            bits[(place % size).astype(np.int64)] = True
            place += step
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass
class Filter:
    """Some blocks; n-grams of others are not told."""

    bits: np.ndarray
    start: np.ndarray  # of each (length, bucket), in bits; -1 if not among them
    size: np.ndarray
    buckets: int

    @classmethod
    def of(cls, blocks: list[tuple[int, int, bytes]], order: int, buckets: int) -> Filter:
        start = np.full((order + 1) * buckets, -1, np.int64)
        size = np.full((order + 1) * buckets, 64, np.uint64)
        at = 0
        for n, bucket, data in blocks:
            start[n * buckets + bucket], size[n * buckets + bucket] = at, 8 * len(data)
            at += 8 * len(data)
        joined = b"".join(data for _, _, data in blocks)
        return cls(np.frombuffer(joined, np.uint8), start, size, buckets)

    def levels(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """The highest level each n-gram is held at."""
        block = n * self.buckets + _bucket(hashes, self.buckets)
        found = np.zeros(len(hashes), np.uint8)
        at = np.flatnonzero(self.start[block] >= 0)
        left = [at, hashes[at], self.size[block[at]], self.start[block[at]].astype(np.uint64)]
        level = 0
        while len(left[0]):
            level += 1
            left += _places(left[1], level)
            for _ in range(PROBES):
                _, _, size, start, place, step = left
                spot = place % size + start
                held = self.bits[(spot >> np.uint64(3)).view(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1 == 1
                place += step
                if not held.all():
                    left = [values[held] for values in left]
            left = left[:4]
            found[left[0]] = level
        return found


@dataclass
class Answers:
    """The levels of a shard's own n-grams, as the blocks of a filter told them."""

    hashes: dict[int, np.ndarray]  # of each length, in order
    held: dict[int, np.ndarray]

    @classmethod
    def of(cls, read: tuple[np.ndarray, np.ndarray], replies: pa.Table, order: int) -> Answers:
        kinds, buckets = replies.column("n").to_pylist(), replies.column("bucket").to_pylist()
        rows = sorted(zip(kinds, buckets, replies.column("data").to_pylist()))
        hashes, held = {}, {}
        for n, own, whole in grams_of(*read, order):
            hashes[n] = np.unique(own[whole])
            held[n] = np.frombuffer(b"".join(d for k, _, d in rows if k == n), np.uint8)
            assert len(held[n]) == len(hashes[n])
        return cls(hashes, held)

    def levels(self, n: int, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes[n]):
            return np.zeros(len(hashes), np.uint8)
        # What stands in no text (where no whole n-gram ends) is told by any other.
        at = np.minimum(np.searchsorted(self.hashes[n], hashes), len(self.hashes[n]) - 1)
        return self.held[n][at]


def _shards(docs: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.col("doc_id").cast("long"), text)
    return docs.select(
        F.pmod(key, F.lit(shards)).cast("int").alias("shard"),
        key.alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        text.alias("text"),
    )


SENT = pa.schema(
    [
        ("n", pa.int32()),
        ("bucket", pa.int32()),
        ("shard", pa.int32()),
        ("hashes", pa.binary()),
        ("counts", pa.binary()),
    ]
)
MADE = pa.schema(
    [
        ("n", pa.int32()),
        ("bucket", pa.int32()),
        ("shard", pa.int32()),
        ("data", pa.binary()),
        ("tokens", pa.int64()),
        ("also", pa.int64()),
    ]
)


def _counted(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sums of their weights."""
    order = np.argsort(hashes, kind="stable")
    hashes, weights = hashes[order], weights[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else order
    sums = np.add.reduceat(weights, first) if len(first) else weights
    return hashes[first], sums


def _send(shard: pa.Table, order: int, buckets: int, ask: bool = False) -> pa.Table:
    """The n-gram counts of a shard's training documents, by bucket of hashes.

    Words of all its documents are sent, with training counts that may be 0; so are
    longer n-grams if the shard asks for their levels.
    """
    tokens, counts = tokens_of(text_bytes(shard.column("text")))
    learned = np.repeat(~shard.column("held_out").to_numpy(), counts)
    number = shard.column("shard")[0].as_py()
    sent: list[tuple] = []

    def deal(n: int, hashes: np.ndarray, weights: np.ndarray) -> None:
        hashes, sums = _counted(hashes, weights.astype(np.uint32))
        edges = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1))
        for bucket, (low, high) in enumerate(zip(edges, edges[1:])):
            if low < high:
                own = hashes[low:high]
                data = own.astype("<u8").tobytes() if n == WORDS else _shorten(own, bucket, buckets)
                sent.append((n, bucket, number, data, _narrow(sums[low:high])))

    deal(WORDS, tokens, learned)
    for n, hashes, whole in grams_of(tokens, counts, order):
        sends = whole if ask else whole & learned
        deal(n, hashes[sends], learned[sends])
    columns = [pa.array(c, f.type) for c, f in zip(zip(*sent), SENT)]
    return pa.Table.from_arrays(columns, schema=SENT)


def _sum(bucket: pa.Table, least: int, buckets: int = 1, ask: bool = False) -> pa.Table:
    """Sums a bucket's counts over all shards: a block of the filter, or for words, and
    for what is asked, the answers to the shards.

    ``tokens`` is the sum of the counts; ``also``, for words, the number of distinct
    ones, and for longer n-grams the tokens whose n-gram would be held without them.
    """
    n, number = bucket.column("n")[0].as_py(), bucket.column("bucket")[0].as_py()
    parts = bucket.column("hashes").to_pylist()
    arrays = [np.frombuffer(p, "<u8") if n == WORDS else _lengthen(p, number, buckets) for p in parts]
    weights = [_widen(c) for c in bucket.column("counts").to_pylist()]
    hashes, sums = _counted(np.concatenate(arrays), np.concatenate(weights).astype(np.int64))
    if n == WORDS:
        rows = [(n, number, REPLY, b"", int(sums.sum()), int((sums > 0).sum()))]
        answer = sums.astype("<u8")
    else:
        levels = level_of(sums, least)
        block = make_block(hashes[levels > 0], levels[levels > 0])
        rows = [(n, number, BITS, b"" if ask else block, int(sums.sum()), int(sums[sums > least].sum()))]
        answer = Filter.of([(n, number, block)], n, buckets).levels(n, hashes) if ask else None
    if answer is not None:
        for shard, own in zip(bucket.column("shard").to_pylist(), arrays):
            rows.append((n, number, shard, answer[np.searchsorted(hashes, own)].tobytes(), 0, 0))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), MADE)], schema=MADE)


def _sorted(shard: pa.Table) -> pa.Table:
    """The shard's documents in an order that every pass sees."""
    return shard.sort_by([(c, "ascending") for c in ("key", "doc_id", "text")])


def _portions(tokens: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole texts, in runs of about as many tokens as are looked up at once."""
    ends = np.cumsum(counts)
    edges = np.searchsorted(ends, np.arange(TOKENS_AT_ONCE, len(tokens), TOKENS_AT_ONCE))
    edges = np.unique(np.concatenate([[0], edges, [len(counts)]])).tolist()
    for low, high in zip(edges, edges[1:]):
        own = counts[low:high]
        yield tokens[ends[high - 1] - own.sum() : ends[high - 1]], own


def _levels(tokens: np.ndarray, counts: np.ndarray, told: Filter | Answers, order: int) -> list[np.ndarray]:
    return [np.where(whole, told.levels(n, hashes), 0).astype(np.uint8) for n, hashes, whole in grams_of(tokens, counts, order)]


@dataclass
class Model:
    order: int
    least: int
    tokens: int
    distinct: int
    documents: int
    weight: dict[int, float]  # of each length against the shorter ones

    def values(self, levels: np.ndarray) -> np.ndarray:
        """The least count of each level: a held n-gram is not taken for more."""
        return np.where(levels > 0, self.least * 2.0 ** (levels.astype(float) - 1), 0.0)

    def score(
        self,
        shard: pa.Table,
        replies: pa.Table,
        told: Filter | None,
        read: tuple[np.ndarray, np.ndarray] | None = None,
    ) -> pa.Table:
        """Scores of a shard's documents. ``replies`` has the counts of its words
        and, where the filter is not at hand, the levels of its n-grams."""
        joined, lengths = read or tokens_of(text_bytes(shard.column("text")))
        distinct = np.unique(joined)
        kinds, buckets = replies.column("n").to_pylist(), replies.column("bucket").to_pylist()
        data = replies.column("data").to_pylist()
        words = sorted((b, d) for k, b, d in zip(kinds, buckets, data) if k == WORDS)
        known = np.frombuffer(b"".join(d for _, d in words), "<u8")
        assert len(known) == len(distinct)
        if told is None:
            slices = [[np.frombuffer(d, np.uint8) for k, d in zip(kinds, data) if k == n] for n in range(2, self.order + 1)]
        found, at = [], 0
        for tokens, counts in _portions(joined, lengths):
            count = known[np.searchsorted(distinct, tokens)].astype(float)
            if told is not None:
                levels = _levels(tokens, counts, told, self.order)
            else:
                levels = [np.maximum.reduce([part[at : at + len(tokens)] for part in parts]) for parts in slices]
            at += len(tokens)
            found.append(self._sums(counts, count, levels))
        counts, n_known, base, score = (np.concatenate(c) for c in zip(*found))
        return pa.table(
            {
                "doc_id": shard.column("doc_id"),
                "held_out": shard.column("held_out"),
                "n_tokens": pa.array(counts),
                "n_known": pa.array(n_known),
                "train_tokens": pa.array(np.full(len(counts), self.tokens, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(score),
            }
        )

    def _sums(self, counts: np.ndarray, count: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Of texts of ``counts`` tokens, found ``count`` times each: their tokens, known ones and both scores."""
        total = self.tokens + self.distinct + 1.0
        chance = (count + 1) / total
        base = np.log10(chance)
        place = np.arange(len(count)) - np.repeat(np.cumsum(counts) - counts, counts)
        context = np.append(0.0, count[:-1])
        context[place == 0] = self.documents
        for n, level in enumerate(levels, 2):
            seen = np.minimum(self.values(level), context)
            weight = self.weight.get(n, 0.0)
            longer = weight * seen / np.maximum(context, 1) + (1 - weight) * chance
            # Without the context there is nothing to learn from this length.
            chance = np.where(context > 0, longer, chance)
            context = np.append(0.0, self.values(level)[:-1])
            context[place < n - 1] = 0
        starts = np.cumsum(counts) - counts
        n_known = np.add.reduceat((count > 0).astype(np.int64), starts)
        return counts, n_known, np.add.reduceat(base, starts), np.add.reduceat(np.log10(chance), starts)


def score_texts(
    docs: DataFrame,
    order: int = ORDER,
    least: int = LEAST_COUNT,
    shard_bytes: int = SHARD_BYTES,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Log10 probabilities of each row's whole text: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score.

    Tokens are the lower-cased (A-Z) words and one end. The model learns from all
    rows but those whose fold is held out; n-grams of two tokens or more that are
    found fewer than ``least`` times are taken as unseen. A null text counts as
    empty: it is its end. Repeated rows count as often as they are there and are
    scored each; a null id counts as '' for the fold; an empty table gives no
    rows; other columns are ignored.

    ``slice_bytes`` bounds what is broadcast. A filter that is sure to fit is;
    of a larger one the blocks answer the shards, with the same scores.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))), F.count("*")).first()
    shards = max(1, -(-(size[0] or 0) // shard_bytes))
    buckets = 1 << max(0, math.ceil(math.log2(shards)))
    dealt = _shards(docs, shards)

    # A token is two bytes or more, or an end, and an n-gram is held once a count at most.
    most = (order - 1) * ((size[0] or 0) // 2 + size[1]) * BITS_PER_ITEM // 8
    ask = most > slice_bytes

    sent = dealt.groupBy("shard").applyInArrow(
        lambda shard: _send(shard, order, buckets, ask),
        "n int, bucket int, shard int, hashes binary, counts binary",
    )
    made = settle(
        sent.groupBy("n", "bucket").applyInArrow(
            lambda bucket: _sum(bucket, least, buckets, ask),
            "n int, bucket int, shard int, data binary, tokens long, also long",
        ),
        "ngrams",
    )
    totals = made.groupBy("n").agg(F.sum("tokens").alias("tokens"), F.sum("also").alias("also"))
    sums = {r["n"]: (r["tokens"], r["also"]) for r in totals.collect()}
    tokens, distinct = sums.pop(WORDS, (0, 0))
    weight = {n: also / max(1, all_of) for n, (all_of, also) in sums.items()}
    documents = docs.where(fold("doc_id", FOLDS) != HELD_OUT).count()
    model = Model(order, least, tokens, distinct, documents, weight)

    replies = made.where(F.col("shard") >= 0).select("shard", "n", "bucket", "data")
    told = None
    if not ask:
        blocks = made.where(F.col("shard") == BITS).select("n", "bucket", "data").collect()
        rows = sorted((r["n"], r["bucket"], bytes(r["data"])) for r in blocks)
        told = docs.sparkSession.sparkContext.broadcast(Filter.of(rows, order, buckets))

    def score(shard: pa.Table, answered: pa.Table) -> pa.Table:
        own = _sorted(shard)
        if told is not None:
            return model.score(own, answered, told.value)
        read = tokens_of(text_bytes(own.column("text")))
        levels = _tell(own, Answers.of(read, answered, order), order, read)
        words = answered.filter(pa.array(answered.column("n").to_numpy() == WORDS))
        return model.score(own, pa.concat_tables([words, levels.cast(words.schema)]), None, read)

    return (
        dealt.groupBy("shard")
        .cogroup(replies.groupBy("shard"))
        .applyInArrow(
            score,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
            " base_score double, score double",
        )
    )


def _tell(
    shard: pa.Table, part: Filter | Answers, order: int, read: tuple[np.ndarray, np.ndarray] | None = None
) -> pa.Table:
    """The levels of the n-grams that end at each token of a shard."""
    own = _sorted(shard) if read is None else shard
    joined = read or tokens_of(text_bytes(own.column("text")))
    found = [_levels(tokens, counts, part, order) for tokens, counts in _portions(*joined)]
    blobs = [b"".join(level.tobytes() for level in levels) for levels in zip(*found)]
    n = len(blobs)
    return pa.table(
        {
            "shard": pa.array([own.column("shard")[0].as_py()] * n, pa.int32()),
            "n": pa.array(range(2, n + 2), pa.int32()),
            "bucket": pa.array([0] * n, pa.int32()),
            "data": pa.array(blobs, pa.binary()),
        }
    )
