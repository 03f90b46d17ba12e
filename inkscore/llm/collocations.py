"""Word collocations of each language by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle. Single words are counted
from the first scan on. After each scan, phrases that have reached their threshold
are marked with the number of the next scan; a phrase one word longer becomes active
with the later mark of its two subphrases, and is counted for one full cycle from
there. So scans of several lengths run at once, and the number of scans is that
of the cycles that the latest marks need. What stands ``least`` times in all shards
stands least / shards times in one of them: that is the threshold of a scan, so no sums
over scans have to be kept, and no frequent phrase goes without its mark.

Marks are held in a table of a fixed number of bytes, in which a phrase has three
places; its mark is the largest of them. A place never changes once it is
set, so every scan sees the same mark. What a phrase finds in the places of others can
only make longer phrases active that need not be, and those are counted for a full
cycle like all others: counts are exact, whatever the size of the table.

Texts are cut into words once, when they are dealt: a block of texts of one language
holds each of its words and that word's hash once, and of every position the number of
its word. Scans read hashes and numbers only. Counts travel under hashes, as sorted
arrays that meet in buckets of hashes, so their rows are few. The words of those that
prove frequent are read in a last pass, in portions of the blocks: a portion tells
only what none before it has told.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import WordHashes, free, mix, remember, settle, shared_folder, text_bytes

SHARDS = 3
# Bytes of the table of marks; several times the phrases that reach the threshold, or
# more phrases are counted and read than need be.
SLOTS = 1 << 24
PLACES = 3
NEVER = 255
# Of a block, and of all blocks that a task has yet to fill.
WORDS_AT_ONCE = 400_000
WORDS_HELD = 4_000_000
# Phrases that a task brings together before it sends their counts.
PHRASES_AT_ONCE = 3_000_000
# Words of a shard to a bucket of hashes.
WORDS_A_BUCKET = 1 << 19
# Parts of the table of marks whose places meet.
SLICES = 32
# The first portion that is read for names is a share of a shard: it tells most of them.
FIRST_PORTION = 8
STEP = np.uint64(0x9E3779B97F4A7C15)
# Characters that end a piece of text.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
NEWLINE, SPACE = 0x0A, 0x20
# Words lower-cased (A-Z), with nothing but spaces and line ends between them.
TO_PLAIN = bytes(NEWLINE if b in ENDS else SPACE if b == 0x09 else b for b in bytes(range(256)).lower())
BLOCKS = "shard int, lang string, words binary, hashes binary, numbers binary, size long"
COUNTS = "bucket int, h binary, n binary"


@dataclass
class Block:
    """Texts of a language: of each position the number of its word, 0 where a piece ends."""

    lang: bytes
    words: bytes  # from number 1 on, each with a line end
    hashes: np.ndarray  # of the words, by number; the first is of none
    numbers: np.ndarray

    @classmethod
    def of(cls, lang: bytes, texts: list[bytes]) -> Block | None:
        """The block of some texts; None if they have no words."""
        from xxhash import xxh3_64_intdigest

        chars = np.frombuffer((b"\n".join(texts) + b"\n").translate(TO_PLAIN), np.uint8)
        ends = chars == NEWLINE
        between = ends | (chars == SPACE)
        edges = np.flatnonzero(np.diff(between, prepend=True))
        if not len(edges):
            return None
        start, stop = edges[::2], edges[1::2]
        offsets = np.append(0, np.cumsum(stop - start))
        data = [None, pa.py_buffer(offsets), pa.py_buffer(chars[~between])]
        told = pa.Array.from_buffers(pa.large_binary(), len(start), data).dictionary_encode()
        words = told.dictionary.to_pylist()
        hashes = np.zeros(len(words) + 1, np.uint64)
        hashes[1:] = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        # An end stands after the last word of each piece.
        line = np.cumsum(ends)[start]
        before = np.append(0, np.cumsum(line[1:] != line[:-1]))
        numbers = np.zeros(len(start) + before[-1] + 1, _narrowest(len(words)))
        numbers[np.arange(len(start)) + before] = told.indices.to_numpy() + 1
        return cls(lang, b"".join(word + b"\n" for word in words), hashes, numbers)

    def grams(self) -> tuple[np.uint64, np.ndarray]:
        """Hashes of the language, and of its words by number."""
        own = mix(WordHashes().of([self.lang]))
        return own[0], mix(self.hashes ^ own)


def blocks_of(rows: Iterable[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, Block]]:
    """Blocks of (shard, language, text) rows."""
    held: dict[tuple[int, bytes], list[bytes]] = {}
    size: dict[tuple[int, bytes], int] = {}

    def full(keys: list[tuple[int, bytes]]) -> Iterator[tuple[int, Block]]:
        for key in keys:
            del size[key]
            block = Block.of(key[1], held.pop(key))
            if block is not None:
                yield key[0], block

    total = 0
    for shard, lang, text in rows:
        key, words = (shard, lang), 1 + len(text) // 6
        held.setdefault(key, []).append(text)
        size[key] = size.get(key, 0) + words
        total += words
        if size[key] >= WORDS_AT_ONCE:
            total -= size[key]
            yield from full([key])
        elif total >= WORDS_HELD:
            total = 0
            yield from full(list(held))
    yield from full(list(held))


def _narrowest(most: int) -> np.dtype:
    return np.min_scalar_type(most).newbyteorder("<")


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the largest needs."""
    return values.astype(_narrowest(int(values.max(initial=0)))).tobytes()


def _widen(data: pa.Buffer, size: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // size}") if size else np.zeros(0, np.uint8)


def _steps(hashes: np.ndarray) -> bytes:
    """Hashes in order: the bytes of a step, the first hash, and the steps from one to the next."""
    if not len(hashes):
        return b""
    steps = np.diff(hashes)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    cut = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + hashes[:1].astype("<u8").tobytes() + cut.tobytes()


def _hashes(data: pa.Buffer | bytes) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.uint64)
    own = np.frombuffer(data, np.uint8)
    cut = own[9:].reshape(-1, int(own[0]))
    steps = np.zeros((len(cut) + 1, 8), np.uint8)
    steps[0], steps[1:, : cut.shape[1]] = own[1:9], cut
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def _buffers(batch: pa.RecordBatch | pa.Table, name: str) -> list[pa.Buffer]:
    return [value.as_buffer() for value in batch.column(name)]


def places_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    """PLACES rows of places in the table of marks."""
    second = mix(hashes) | np.uint64(1)
    steps = (hashes + np.uint64(i) * second for i in range(PLACES))
    # The remainder, which of a power of two are the last bits.
    whole = slots & (slots - 1) == 0
    return np.stack([s & np.uint64(slots - 1) if whole else s % np.uint64(slots) for s in steps]).view(np.int64)


def marks_of(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return marks[places_of(hashes, len(marks))].max(axis=0)


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases by those of all words but the last, and the last."""
    return mix(hashes * STEP + words)


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sums of their counts."""
    joined = np.concatenate([np.zeros(0, np.uint64), *hashes])
    weights = np.concatenate([np.zeros(0, np.int64), *counts])
    if not len(joined):
        return joined, weights
    order = np.argsort(joined)
    joined = joined[order]
    first = np.flatnonzero(np.append(True, joined[1:] != joined[:-1]))
    return joined[first], np.add.reduceat(weights[order], first)


class Scan:
    """Counts the active phrases of texts in one scan."""

    def __init__(self, number: int, marks: np.ndarray, longest: int, shards: int):
        self.number, self.marks = number, marks
        self.longest, self.shards = longest, shards
        self.clear()

    def clear(self) -> None:
        self.held = 0
        # Phrases of one word (and languages) with their counts, longer ones as they come.
        self.hashes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.grams: list[np.ndarray] = []

    def add(self, block: Block) -> None:
        """Notes the active phrases of a block; under the hash of a language its words."""
        numbers, number = block.numbers, self.number
        own, known = block.grams()
        if number < self.shards:
            counts = np.bincount(numbers, minlength=len(known))[1:]
            self.hashes += [np.array([own]), known[1:]]
            self.counts += [np.array([counts.sum()]), counts]
            self.held += 1 + len(counts)
        if not number:
            return  # Nothing has a mark yet.
        marks = marks_of(known, self.marks)
        marks[0] = NEVER
        mark = marks[numbers]
        at = np.arange(len(numbers))
        grams = known[numbers] if self.longest > 1 else known
        for k in range(2, self.longest + 1):
            # The phrase that is a word longer holds this one and the next, and no end.
            start = np.append(np.maximum(mark[:-1], mark[1:]), np.uint8(NEVER))
            begun = start[at] <= number
            at, grams = at[begun], grams[begun]
            grams = longer(grams, block.hashes[numbers[at + (k - 1)]])
            first = start[at]
            self.grams.append(grams[number < first.astype(np.int64) + self.shards])
            self.held += len(self.grams[-1])
            if k < self.longest:
                mark = np.full(len(numbers), NEVER, np.uint8)
                # No phrase acts on marks that others set before it was counted itself.
                mark[at] = np.maximum(marks_of(grams, self.marks), first)

    def told(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes in order and counts of what was noted, which is let go."""
        noted = self.hashes, self.counts, self.grams
        self.clear()
        yield summed(*noted[:2])
        if noted[2]:
            yield np.unique(np.concatenate(noted[2]), return_counts=True)

    def of(self, texts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        """Hashes and counts of the phrases of (language, text) rows."""
        for _, block in blocks_of((0, *row) for row in texts):
            self.add(block)
        for hashes, counts in self.told():
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["h", "n"])


TOLD, OPEN = 0, 1


class Names:
    """Words of the phrases whose hash is in a table of places, each once a task.

    A place holds NEVER, TOLD, or OPEN if a phrase that falls on it has yet to be told.
    """

    def __init__(self, table: np.ndarray, longest: int):
        self.table, self.longest = table, longest
        self.seen = np.zeros(0, np.uint64)

    def is_open(self, hashes: np.ndarray) -> np.ndarray:
        return (self.table[places_of(hashes, len(self.table))] == OPEN).all(axis=0)

    def fresh(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that are open and were not seen, in order, each once, and where each stands first."""
        at = np.flatnonzero(self.is_open(hashes))
        new, first = np.unique(hashes[at], return_index=True)
        place = np.searchsorted(self.seen, new)
        unseen = np.append(self.seen, np.uint64(0))[place] != new
        unseen |= place == len(self.seen)
        self.seen = np.insert(self.seen, place[unseen], new[unseen])
        return new[unseen], at[first[unseen]]

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        numbers = block.numbers
        own, known = block.grams()
        words: list[bytes] = []
        new, at = self.fresh(np.array([own]))
        hashes, names = [new], [block.lang + b"\n"] * len(at)

        def tell(new: np.ndarray, phrases: np.ndarray) -> None:
            if len(new) and not words:
                words.extend([b"", *block.words.split(b"\n")])
            hashes.append(new)
            for phrase in phrases.tolist():
                names.append(block.lang + b"\n" + b" ".join([words[i] for i in phrase]))

        frequent = marks_of(known, self.table) != NEVER
        frequent[0] = False
        one = np.flatnonzero(frequent)
        new, first = self.fresh(known[one])
        tell(new, one[first].reshape(-1, 1))
        held = frequent[numbers]
        at = np.arange(len(numbers))
        grams = known[numbers] if self.longest > 1 else known
        for k in range(2, self.longest + 1):
            # A longer frequent phrase has this one and the next, and no end.
            there = (held & np.append(held[1:], False))[at]
            at, grams = at[there], grams[there]
            grams = longer(grams, block.hashes[numbers[at + (k - 1)]])
            there = marks_of(grams, self.table) != NEVER
            at, grams = at[there], grams[there]
            new, first = self.fresh(grams)
            tell(new, numbers[at[first].reshape(-1, 1) + np.arange(k)])
            held = np.zeros(len(numbers), bool)
            held[at] = True
        told = pa.array(names, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), told], names=["h", "name"])

    def of(self, texts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        for _, block in blocks_of((0, *row) for row in texts):
            yield from self.add(block)


def _deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of lang, text, shard rows."""
    remember(None)

    def rows() -> Iterator[tuple[int, bytes, bytes]]:
        for batch in batches:
            shard, lang, text = (batch.column(c) for c in ("shard", "lang", "text"))
            yield from zip(shard.to_pylist(), text_bytes(lang), text_bytes(text))

    for shard, block in blocks_of(rows()):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()),
                pa.array([block.lang], pa.binary()).cast(pa.string()),
                pa.array([block.words], pa.binary()),
                pa.array([block.hashes.astype("<u8").tobytes()], pa.binary()),
                pa.array([block.numbers.tobytes()], pa.binary()),
                pa.array([len(block.numbers)], pa.int64()),
            ],
            names=["shard", "lang", "words", "hashes", "numbers", "size"],
        )


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of lang, hashes, numbers, size and, where they are asked for, words."""
    for batch in batches:
        langs, sizes = text_bytes(batch.column("lang")), batch.column("size").to_pylist()
        words = _buffers(batch, "words") if "words" in batch.schema.names else [b""] * len(langs)
        for lang, own, hashes, numbers, size in zip(
            langs, words, _buffers(batch, "hashes"), _buffers(batch, "numbers"), sizes
        ):
            yield Block(lang, bytes(own), np.frombuffer(hashes, "<u8"), _widen(numbers, size))


def _counts(bucket: pa.RecordBatch | pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes and counts, row by row."""
    hashes = [_hashes(h) for h in _buffers(bucket, "h")]
    return hashes, [_widen(n, len(h)).astype(np.int64) for n, h in zip(_buffers(bucket, "n"), hashes)]


def _by_part(values: np.ndarray, lowest: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The parts that sorted values fall in, by the lowest value of each part."""
    edges = np.append(np.searchsorted(values, lowest), len(values)).tolist()
    for part, (low, high) in enumerate(zip(edges, edges[1:])):
        if low < high:
            yield part, slice(low, high)


def _dealt(hashes: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket that sorted hashes fall in."""
    lowest = np.arange(buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets % (1 << 64))
    parts = list(_by_part(hashes, lowest))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part for part, _ in parts], pa.int32()),
            pa.array([_steps(hashes[own]) for _, own in parts], pa.binary()),
            pa.array([_narrow(counts[own]) for _, own in parts], pa.binary()),
        ],
        names=["bucket", "h", "n"],
    )


def _scan_over(made: Callable[[], Scan], buckets: int) -> Callable:
    """A function for mapInArrow from blocks to counts by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = made()
        for block in _read(batches):
            scan.add(block)
            if scan.held >= PHRASES_AT_ONCE:
                yield from (_dealt(*counted, buckets) for counted in scan.told())
        yield from (_dealt(*counted, buckets) for counted in scan.told())

    return run


def _names_over(made: Callable[[], Names]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = made()
        for block in _read(batches):
            yield from names.add(block)

    return run


def _summed(counts: DataFrame, reach: int) -> DataFrame:
    """A row for each bucket: its hashes and counts, and the hashes that reach a count."""

    def run(bucket: pa.Table) -> pa.Table:
        hashes, sums = summed(*_counts(bucket))
        return pa.table(
            {
                "bucket": bucket.column("bucket")[:1],
                "h": pa.array([_steps(hashes)], pa.binary()),
                "n": pa.array([_narrow(sums)], pa.binary()),
                "reached": pa.array([_steps(hashes[sums >= reach])], pa.binary()),
            }
        )

    return counts.groupBy("bucket").applyInArrow(run, f"{COUNTS}, reached binary")


def _places(hashes: DataFrame, slots: int) -> np.ndarray:
    """Places in the table of marks of hashes, in rows or as arrays: at most one number for each place."""
    schema = "slice int, places binary"

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = np.arange(SLICES) * slots // SLICES
        for batch in batches:
            column = batch.column(0)
            if pa.types.is_binary(column.type):
                arrays = [_hashes(value.as_buffer()) for value in column]
            else:
                arrays = [column.to_numpy().view(np.uint64)]
            places = np.unique(places_of(np.concatenate([np.zeros(0, np.uint64), *arrays]), slots)).astype("<i4")
            parts = list(_by_part(places, lowest))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part for part, _ in parts], pa.int32()),
                    pa.array([places[own].tobytes() for _, own in parts], pa.binary()),
                ],
                names=["slice", "places"],
            )

    def meet(part: pa.Table) -> pa.Table:
        places = np.unique(np.concatenate([np.frombuffer(p, "<i4") for p in _buffers(part, "places")]))
        return pa.table({"slice": part.column("slice")[:1], "places": pa.array([places.tobytes()], pa.binary())})

    met = hashes.mapInArrow(deal, schema).groupBy("slice").applyInArrow(meet, schema).toArrow()
    return np.concatenate([np.zeros(0, "<i4"), *(np.frombuffer(p, "<i4") for p in _buffers(met, "places"))])


def _marked(counts: DataFrame, marks) -> DataFrame:
    """The counts of the phrases that have a mark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for hashes, own in zip(*_counts(batch)):
                kept = marks_of(hashes, marks.value) != NEVER
                rows.append((_steps(hashes[kept]), _narrow(own[kept])))
            columns = [pa.array(c, pa.binary()) for c in zip(*rows)]
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("bucket"), *columns], names=["bucket", "h", "n"])

    return counts.select("bucket", "h", "n").mapInArrow(run, COUNTS)


def _frequent(counts: DataFrame, least: int) -> DataFrame:
    """h, f of the phrases that stand ``least`` times or more in all counts."""

    def run(bucket: pa.Table) -> pa.Table:
        hashes, sums = summed(*_counts(bucket))
        kept = sums >= least
        return pa.table({"h": hashes[kept].view(np.int64), "f": sums[kept]})

    return counts.groupBy("bucket").applyInArrow(run, "h long, f long")


def dealt_texts(docs: DataFrame, shards: int) -> DataFrame:
    """The rows with words as blocks (:class:`Block`), in files by shard."""
    spark = docs.sparkSession
    path = shared_folder(spark, "shards")
    text, lang = (F.col(c).cast("string") for c in ("text", "lang"))
    shard = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(shards)).cast("int")
    plain = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), text.alias("text"), shard.alias("shard"))
    blocks = plain.where(F.length("text") > 0).mapInArrow(_deal, BLOCKS)
    blocks.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    rows = spark.read.schema(T.StructType.fromDDL(BLOCKS)).parquet(path)
    rows.settled_at = path
    return rows


def count_phrases(rows: DataFrame, longest: int, least: int, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """h, f: exact counts of all phrases of up to ``longest`` words that stand ``least``
    times or more in ``rows`` (as of :func:`dealt_texts`), under their hashes, and of all
    words of a language under its own."""
    if shards * (longest + 2) >= NEVER:
        raise ValueError("fewer shards, please: a mark is one byte")
    context = rows.sparkSession.sparkContext
    size = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    buckets = 1 << max(0, math.ceil(math.log2(max(1, size / WORDS_A_BUCKET))))
    marks = np.full(slots, NEVER, np.uint8)
    scans: list[DataFrame] = []
    number, last = 0, 0
    # A length is complete a cycle after the one before, at the latest.
    while number < min(last + shards, longest * shards):
        told = context.broadcast(marks)
        own = rows.where(F.col("shard") == number % shards).select("lang", "hashes", "numbers", "size")
        counted = own.mapInArrow(_scan_over(_scan_of(number, told, longest, shards), buckets), COUNTS)
        scans.append(settle(_summed(counted, -(-least // shards)), "scan"))
        told.destroy()
        reached = _places(scans[-1].select("reached"), slots)
        fresh = reached[marks[reached] == NEVER]
        if len(fresh):
            marks = marks.copy()
            marks[fresh] = number + 1
            last = number + 1
        number += 1
    told = context.broadcast(marks)
    marked = _marked(functools.reduce(DataFrame.unionByName, scans), told)
    frequent = settle(_frequent(marked, least), "frequent")
    told.destroy()
    free(*scans)
    return frequent


def name_phrases(rows: DataFrame, frequent: DataFrame, longest: int, slots: int = SLOTS) -> DataFrame:
    """k, lang, phrase, f of the frequent phrases; k = 0: a language and its words."""
    table = np.full(slots, NEVER, np.uint8)
    table[_places(frequent.select("h"), slots)] = OPEN
    phrase = F.substring_index("name", "\n", -1)
    lang = F.expr("substring(name, 1, length(name) - length(substring_index(name, '\n', -1)) - 1)")
    k = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))
    parts: list[DataFrame] = []
    left = frequent
    for portion in _portions(rows):
        told = rows.sparkSession.sparkContext.broadcast(table)
        own = portion.select("lang", "words", "hashes", "numbers", "size")
        named = own.mapInArrow(_names_over(_names_of(told, longest)), "h long, name string")
        once = named.groupBy("h").agg(F.min("name").alias("name"))
        own = left.join(once, "h").select("h", k.alias("k"), lang.alias("lang"), phrase.alias("phrase"), "f")
        parts.append(settle(own, "phrases"))
        told.destroy()
        left = frequent.join(functools.reduce(DataFrame.unionByName, parts).select("h"), "h", "left_anti")
        still = _places(left.select("h"), slots)
        if not len(still):
            break
        table = np.where(table == NEVER, table, np.uint8(TOLD))
        table[still] = OPEN
    return functools.reduce(DataFrame.unionByName, parts).select("k", "lang", "phrase", "f")


def _portions(rows: DataFrame) -> Iterator[DataFrame]:
    """All rows, in portions by shard; a share of the first shard comes first."""
    for shard in sorted(r["shard"] for r in rows.select("shard").distinct().collect()) or [0]:
        own = rows.where(F.col("shard") == shard)
        if shard:
            yield own
        else:
            first = F.pmod(F.xxhash64("numbers"), F.lit(FIRST_PORTION)) == 0
            yield own.where(first)
            yield own.where(~first)


def _names_of(told, longest: int):
    return lambda: Names(told.value, longest)


def _scan_of(number: int, told, longest: int, shards: int):
    return lambda: Scan(number, told.value, longest, shards)


def _score(a, left, right):
    """floor(1000000 a a / (left right)), exact."""
    wide = "decimal(15,0)"
    top = F.lit(1_000_000).cast("decimal(7,0)") * a.cast(wide) * a.cast(wide)
    return F.call_function("div", top, left.cast(wide) * right.cast(wide))


def mine_collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    inside: int = 50,
    top: int = 2000,
    shards: int = SHARDS,
    slots: int = SLOTS,
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts end a piece at ``.,;:!?`` and line ends; words (A-Z lower-cased) are what
    spaces and tabs separate. Phrases of 2 to ``longest`` words within a piece that
    stand ``least`` times (a) or more are candidates. A cut into two parts that stand
    l and r times scores floor(1000000 a a / (l r)); the lowest cut counts, then the
    first. A candidate inside a longer one that stands at least ``inside`` % as often
    is left out. n is the number of words of the language; ranks go by score, a and
    phrase.

    A null language is ``und``, a null text empty; repeated rows count each time;
    ids only deal the rows into shards. An empty table gives no rows; other
    columns are ignored. A language may hold all rows: counts are combined before
    they move, and ranks are cut before they meet. Phrases are told apart by hashes
    of 64 bits.
    """
    rows = dealt_texts(docs, shards)
    frequent = name_phrases(rows, count_phrases(rows, longest, least, shards, slots), longest, slots)
    free(rows)
    words = frequent.where("k = 0").select("lang", F.col("f").alias("n"))
    candidates = frequent.where("k >= 2").select(
        "k", "lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words")
    )

    def part(start, length):
        return F.concat_ws(" ", F.slice("words", start, length))

    cuts = candidates.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut",
        part(F.lit(1), F.col("cut")).alias("first"),
        part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"),
    )
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    lowest = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r"))
    scored = met.groupBy("lang", "phrase", "a").agg(lowest.alias("c"))

    spans = F.expr(
        "flatten(transform(sequence(2, k - 1), q -> transform(sequence(1, k - q + 1),"
        " s -> concat_ws(' ', slice(words, s, q)))))"
    )
    holders = candidates.where("k >= 3").select("lang", "a", F.explode(spans).alias("phrase"))
    most = holders.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    stays = scored.join(most, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = stays.select("lang", "phrase", "a", "c.*").withColumn("rank", F.row_number().over(order))
    kept = ranked.where(F.col("rank") <= top).join(words, "lang")
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
