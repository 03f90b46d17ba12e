"""Documents that hold a benchmark item, give or take a few words.

Edits are counted in words. An item of n words may differ in up to
e = floor(rate * n) of them. Split into e + 1 pieces, it leaves at least one
piece untouched by e edits, so every match holds some piece exactly: an
automaton over the pieces of all items finds those, and Myers' bit-parallel
algorithm takes the distance of the item around each hit.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, in_batches, settle, with_column

WORD = re.compile(r"[^\W_]+")
ERROR_RATE = 0.2
# Text of items that goes to the workers at once; more is done in blocks.
BLOCK_BYTES = 16_000_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall(text.lower()) if text else []


def pieces_of(words: list[str], errors: int) -> list[tuple[int, list[str]]]:
    """errors + 1 pieces of nearly equal length, with their offsets."""
    edges = [len(words) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, words[a:b]) for a, b in zip(edges, edges[1:])]


def masks_of(pattern: list[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


def least_distance(masks: dict[str, int], m: int, text: Iterable[str]) -> tuple[int, int]:
    """Least edit distance of a pattern of ``m`` words to any run of ``text``.

    Returns it with the (exclusive) end of the first run that has it. Myers'
    algorithm: one column of vertical differences is two bit vectors.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, word in enumerate(text, 1):
        equal = masks.get(word, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        right = down | ~(across | up)
        left = up & across
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right <<= 1
        left <<= 1
        up = (left | ~(vertical | right)) & full
        down = right & vertical & full
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds items in texts; ``items`` are (id, text)."""

    def __init__(self, items: list[tuple], rate: float = ERROR_RATE):
        import ahocorasick

        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for identity, text in items:
            words = words_of(text)
            if not words:
                continue
            errors = int(rate * len(words))
            for offset, piece in pieces_of(words, errors):
                pieces.setdefault(f" {' '.join(piece)} ", []).append((len(self.items), offset))
            self.items.append((identity, len(words), errors, masks_of(words)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """(item id, distance, words of the item, end word) for each item found,
        at the place of its least distance."""
        words = words_of(text)
        if not words or not self.items:
            return []
        joined = f" {' '.join(words)} "
        starts = None
        tried: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int]] = {}
        for last, (length, places) in self.automaton.iter(joined):
            if starts is None:
                lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
                starts = np.cumsum(lengths) - lengths
            at = int(np.searchsorted(starts, last - length + 1))
            for item, offset in places:
                begin = at - offset
                if (item, begin) in tried or best.get(item, (1, 0))[0] == 0:
                    continue
                tried.add((item, begin))
                _, m, errors, masks = self.items[item]
                low = max(0, begin - errors)
                distance, end = least_distance(masks, m, words[low : begin + m + errors])
                if distance <= errors and distance < best.get(item, (errors + 1, 0))[0]:
                    best[item] = (distance, low + end)
        return [(self.items[i][0], d, self.items[i][1], end) for i, (d, end) in best.items()]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = ERROR_RATE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each document with each item it holds: doc_id, item_id, distance, item_words, end_word.

    Clean documents have no row. An item of fewer than 1 / ``rate`` words must
    stand as it is; one without words (null, empty) is in no document, as is
    every item in a document without words. Items of equal text are found each
    on its own, repeated rows of documents give repeated rows, null ids stay null.
    The items go to the workers in blocks of about ``block_bytes`` of text, so what
    a worker holds does not grow with the benchmark.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, distance int, item_words int, end_word int"
    blocks = _blocks(benchmark, block_bytes)
    found = []
    for items in blocks:
        shared = _shared(items)
        own = plain.mapInArrow(in_batches(_finder(shared, rate)), schema)
        if len(blocks) > 1:
            # One block at a time is in the driver and in the workers.
            own = settle(own, "contaminated")
            shared.destroy()
        found.append(own)
    return functools.reduce(DataFrame.unionByName, found)


def without_items(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = ERROR_RATE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows, all columns, in which :func:`contaminated` finds nothing.

    A single block of items filters the rows where they are. With several, each
    block settles the keys of the rows it is found in, and the rows whose key is
    among them go in the end: no copy of the documents is made in between.
    """
    blocks = _blocks(benchmark, block_bytes)
    name = free_name(docs, "holds_item")
    if len(blocks) == 1:
        marked = with_column(docs, name, T.BooleanType(), _marker(_shared(blocks[0]), rate))
        return marked.where(~F.col(f"`{name}`")).select(*docs.columns)
    keyed = docs.select(*_keys(), F.col("text").cast("string").alias("text"))
    hits = []
    for items in blocks:
        shared = _shared(items)
        marked = with_column(keyed, name, T.BooleanType(), _marker(shared, rate))
        hits.append(settle(marked.where(F.col(name)).select("_one", "_two"), "hits"))
        shared.destroy()
    found = functools.reduce(DataFrame.unionByName, hits).distinct()
    one, two = _keys()
    return docs.join(found, (one == found["_one"]) & (two == found["_two"]), "left_anti")


def _keys() -> tuple[Column, Column]:
    """128 bits of a row's id and text, on which the verdict depends."""
    row = (F.col("doc_id").cast("string"), F.lit("of"), F.col("text").cast("string"))
    return F.xxhash64(*row).alias("_one"), F.xxhash64(F.lit("other"), *row).alias("_two")


def _shared(items: DataFrame):
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    return items.sparkSession.sparkContext.broadcast(rows)


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in tables of about ``block_bytes`` of text; none is empty, but for
    the only one of an empty benchmark."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where(F.length("text") > 0)
    size, rows = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = min(-(-(size or 0) // block_bytes), rows)
    if blocks <= 1:
        return [items]
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    held = sorted(row[0] for row in items.select(dealt).distinct().collect())
    return [items.where(dealt == block) for block in held]


class _Lazy:
    """A matcher made where it is used, once for each task."""

    def __init__(self, shared, rate: float):
        self.shared, self.rate, self.made = shared, rate, None

    def find(self, text: str | None) -> list[tuple]:
        if self.made is None:
            self.made = Matcher(self.shared.value, self.rate)
        return self.made.find(text)


def _marker(shared, rate: float):
    lazy = _Lazy(shared, rate)
    return lambda texts: pa.array([bool(lazy.find(t)) for t in texts], pa.bool_())


def _finder(shared, rate: float):
    lazy = _Lazy(shared, rate)

    def find(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [
            (doc_id, *hit)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for hit in lazy.find(text)
        ]
        if not rows:
            return None
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        names = ["doc_id", "item_id", "distance", "item_words", "end_word"]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return find
