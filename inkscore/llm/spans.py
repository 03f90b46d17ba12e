"""Removal of word sequences that stand elsewhere before.

A window of ``size`` words is an edge of a De Bruijn graph over words. Edges are
not dealt one by one: those that follow one another in a text and share their
least k-mer (the minimizer, chosen by hash) form a path, and equal paths of all
texts compact into one by a grouping on (minimizer, content). All but the first
place of a compacted path repeat it. An edge that stands in two different
paths has the same minimizer in both, so only under a minimizer with more than
one path, where the graph branches, are the edges themselves compared, read
again at the path's source coordinate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD_HASHES, in_batches, mix, settle, text_bytes

SIZE = 20
KMER = 6
# Words that are turned into arrays together, and the odd bases of the hashes.
WORDS_AT_ONCE = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SECOND_LANE = np.uint64(0xD6E8FEB86659FD93)
LEAST = -(1 << 63)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    values = np.full(n, base, np.uint64)
    if n:
        values[0] = 1
    return np.multiply.accumulate(values)


def sums_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for :func:`hash_between`."""
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(BASE, n), out=sums[1:])
    return sums, _powers(INVERSE, n + 1)


def hash_between(sums: tuple[np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the words low .. high - 1 that depends on the words alone."""
    total, unshift = sums
    return mix((total[high] - total[low]) * unshift[low] + (high - low).astype(np.uint64))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value of each run of ``width`` values."""
    n = len(values) - width + 1
    least, have = values, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    place = np.zeros(n, np.int64)
    for offset in range(width - 1, -1, -1):
        same = values[offset : offset + n] == least
        place[same] = np.flatnonzero(same) + offset
    return place


def paths_of(hashes: np.ndarray, lengths: np.ndarray, size: int, kmer: int):
    """Paths of the windows of several texts, whose words' hashes are joined.

    Returns arrays: place of the first window, number of windows, minimizer,
    content; places count over the joined words.
    """
    n = len(hashes)
    ends = np.repeat(np.cumsum(lengths), lengths)
    window = np.flatnonzero(np.arange(n) + size <= ends)
    if not len(window):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    sums = sums_of(hashes)
    starts = np.arange(n - kmer + 1)
    seeds = hash_between(sums, starts, starts + kmer)
    place = least_in_windows(seeds, size - kmer + 1)[window]
    new = np.append(True, (np.diff(window) != 1) | (np.diff(place) != 0))
    first = window[new]
    count = np.diff(np.append(np.flatnonzero(new), len(window)))
    second = sums_of(mix(hashes ^ SECOND_LANE))
    return first, count, seeds[place[new]], hash_between(second, first, first + count + size - 1)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (as numbers), joined word hashes and word counts, some texts at a time."""
    rows, found, total = [], [], 0
    for row, text in enumerate(text_bytes(batch.column("text"))):
        own = WORD_HASHES.of(text.split())
        rows.append(row)
        found.append(own)
        total += len(own)
        if total >= WORDS_AT_ONCE:
            yield np.array(rows), np.concatenate(found), np.array([len(f) for f in found])
            rows, found, total = [], [], 0
    if rows:
        yield np.array(rows), np.concatenate(found), np.array([len(f) for f in found])


def _place_rows(batch: pa.RecordBatch, size: int, kmer: int) -> Iterator[list[np.ndarray]]:
    doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
    for rows, hashes, lengths in _chunks(batch):
        first, count, seed, content = paths_of(hashes, lengths, size, kmer)
        own = np.searchsorted(np.cumsum(lengths), first, "right")
        pos = first - (np.cumsum(lengths) - lengths)[own]
        row = rows[own]
        yield [
            doc[row],
            tie[row],
            pos.astype(np.int32),
            count.astype(np.int32),
            seed.view(np.int64),
            content.view(np.int64),
        ]


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """The documents under a key without nulls: the id, and a hash of the text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"),
        F.hash("text").alias("tie"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def _later(keys: list[np.ndarray], place: list[np.ndarray]) -> np.ndarray:
    """Rows whose keys stand at a smaller place in the same arrays."""
    order = np.lexsort([*reversed(place), *keys])
    same = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        same &= np.diff(key[order]) == 0
    # Each row's first row of the same keys, then whether its place is another one.
    head = np.maximum.accumulate(np.append(0, np.where(same, 0, np.arange(1, len(order)))))[: len(order)]
    first = order[head]
    later = np.zeros(len(order), bool)
    later[order] = np.any([p[order] != p[first] for p in place], axis=0)
    return later


def _dealt(key: np.ndarray, later: np.ndarray, place: list[np.ndarray]) -> np.ndarray:
    """Where a row is judged: by its key, or anywhere if it is known to repeat.

    So of a run of words that a batch of texts has many times one row goes to the
    task of its key, and no task gets all the copies.
    """
    anywhere = mix(place[0].view(np.uint64) + place[2].astype(np.uint64) * BASE)
    return np.where(later, anywhere.view(np.int64), key)


def _paths(keyed: DataFrame, size: int, kmer: int) -> DataFrame:
    """All paths: doc, tie, pos, n, content, later (a batch has it before), route."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tie, pos, n, seed, content in _place_rows(batch, size, kmer):
                place = [doc, tie, pos]
                later = _later([seed, content], place)
                route = _dealt(seed, later, place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (doc, tie, pos, n, content, later, route)],
                    names=["doc", "tie", "pos", "n", "content", "later", "route"],
                )

    schema = "doc long, tie int, pos int, n int, content long, later boolean, route long"
    return keyed.mapInArrow(make, schema)


def _judged(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ``again``: the keys stand at a smaller place. Rows are dealt by route."""
    place = F.struct("doc", "tie", "pos")
    own = Window.partitionBy("route", *keys, "later").orderBy("doc", "tie", "pos")
    again = F.col("later") | (place != F.first(place).over(own))
    return rows.repartition("route").withColumn("again", again)


def repeated_paths(keyed: DataFrame, size: int = SIZE, kmer: int = KMER) -> DataFrame:
    """Paths that repeat (again), and first ones whose minimizer has other paths
    beside them, where the graph branches: doc, tie, pos, n, again."""
    judged = _judged(_paths(keyed, size, kmer), "content", "n")
    beside = F.sum((~F.col("again")).cast("int")).over(Window.partitionBy("route", "later"))
    counted = judged.withColumn("beside", beside)
    return counted.where("again or beside > 1").select("doc", "tie", "pos", "n", "again")


def _windows_at(keyed: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """Two hashes of each window of the asked runs, read from the texts."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
        asked = batch.column("asked").to_pylist()
        found = []
        for rows, hashes, lengths in _chunks(batch):
            sums, second = sums_of(hashes), sums_of(mix(hashes ^ SECOND_LANE))
            starts = np.cumsum(lengths) - lengths
            for row, start in zip(rows.tolist(), starts.tolist()):
                runs = np.array([(r["pos"], r["n"]) for r in asked[row]], np.int64)
                n = runs[:, 1]
                pos = np.repeat(runs[:, 0] - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = pos + start
                found.append(
                    [
                        np.full(len(pos), doc[row]),
                        np.full(len(pos), tie[row]),
                        pos.astype(np.int32),
                        hash_between(sums, at, at + size).view(np.int64),
                        hash_between(second, at, at + size).view(np.int64),
                    ]
                )
        *place, one, two = (np.concatenate(c) for c in zip(*found))
        later = _later([one, two], place)
        columns = [*place, two, later, _dealt(one, later, place)]
        return pa.RecordBatch.from_arrays(
            list(map(pa.array, columns)), names=["doc", "tie", "pos", "h", "later", "route"]
        )

    lists = places.groupBy("doc", "tie").agg(F.collect_list(F.struct("pos", "n")).alias("asked"))
    met = keyed.join(lists, ["doc", "tie"]).select("doc", "tie", "text", "asked")
    schema = "doc long, tie int, pos int, h long, later boolean, route long"
    return met.mapInArrow(in_batches(make), schema)


def repeated_windows(keyed: DataFrame, size: int = SIZE, kmer: int = KMER) -> DataFrame:
    """Runs of windows whose words also start at a place before: doc, tie, pos, n."""
    paths = settle(repeated_paths(keyed, size, kmer), "paths")
    again = paths.where("again").select("doc", "tie", "pos", "n")
    branching = paths.where("not again").select("doc", "tie", "pos", "n")
    windows = _judged(_windows_at(keyed, branching, size), "h").where("again")
    return again.unionByName(windows.select("doc", "tie", "pos", F.lit(1).alias("n")))


def remove_repeats(docs: DataFrame, size: int = SIZE, kmer: int = KMER) -> DataFrame:
    """Documents without the words that repeated windows cover.

    Returns doc_id, n_words, n_removed, kept (the words that stay, joined by one
    space) and removed (spans of word numbers, start and end, merged). A window
    counts as repeated if its words also start at a place before, in a document
    with a smaller id or earlier in the same one; this is judged on the input.

    A null text has no words; a document shorter than a window loses none. A null
    id is smaller than every other. Rows with one id are ordered by a hash of
    their text; rows that share id and text count as one document and get the
    same result. An empty table gives no rows; other columns are ignored.
    """
    keyed = _keyed(docs)
    cut = _with_cut(keyed, keyed, size, kmer)
    doc_id = F.when(F.col("doc") != LEAST, F.col("doc")).alias("doc_id")
    return cut.select(doc_id, "cut.n_words", "cut.n_removed", "cut.kept", "cut.removed")


def with_repeats_removed(docs: DataFrame, size: int = SIZE, kmer: int = KMER) -> DataFrame:
    """All rows and columns, the texts without what :func:`remove_repeats` removes.

    A text that loses nothing stays as it is, white space and nulls included; the
    words that another one keeps are joined by one space. A column n_chars follows
    the text.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    row = F.struct(*others).alias("row")
    whole = _keyed(docs, row, F.col("text").isNull().alias("none"))
    cut = _with_cut(whole, _keyed(docs), size, kmer)
    lost = F.col("cut.n_removed") > 0
    text = F.when(lost, F.col("cut.kept")).when(~F.col("none"), F.col("text"))
    kinds = {f.name: f.dataType for f in docs.schema}

    def column(name: str) -> Column:
        if name.lower() == "text":
            return text.cast(kinds[name]).alias(name)
        own = F.col("row").getField(name)
        if name.lower() == "n_chars":
            own = F.when(lost, F.length(F.col("cut.kept")).cast(kinds[name])).otherwise(own)
        return own.alias(name)

    return cut.select(*[column(c) for c in docs.columns])


CUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField(
            "removed",
            T.ArrayType(
                T.StructType(
                    [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
                )
            ),
        ),
    ]
)


def cut_text(text: bytes, runs: list[dict] | None, size: int) -> dict:
    """The text without the words under the runs of windows."""
    words = text.split()
    if not runs:
        return {"n_words": len(words), "n_removed": 0, "kept": b" ".join(words).decode(), "removed": []}
    level = np.zeros(len(words) + 1, np.int64)
    pos, n = np.array([(r["pos"], r["n"]) for r in runs]).T
    np.add.at(level, pos, 1)
    np.add.at(level, pos + n + size - 1, -1)
    gone = np.cumsum(level[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return {
        "n_words": len(words),
        "n_removed": int(gone.sum()),
        "kept": b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]).decode(),
        "removed": [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()],
    }


def _with_cut(whole: DataFrame, keyed: DataFrame, size: int, kmer: int) -> DataFrame:
    """``whole`` (doc, tie, text and more) with the struct CUT in column ``cut``."""
    runs = repeated_windows(keyed, size, kmer)
    lists = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("pos", "n")).alias("runs"))
    names = whole.columns
    met = whole.join(lists, ["doc", "tie"], "left").select(*names, "runs")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", span)]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, runs = text_bytes(batch.column("text")), batch.column("runs").to_pylist()
        made = [cut_text(text, own, size) for text, own in zip(texts, runs)]
        kept = batch.select(names)
        return pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(made, pa.struct(kinds))], names=[*names, "cut"]
        )

    schema = T.StructType([*whole.schema.fields, T.StructField("cut", CUT)])
    return met.mapInArrow(in_batches(cut), schema)
