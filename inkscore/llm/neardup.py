"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits; documents whose fingerprints differ in at most
``radius`` bits are linked. Every bit gets a non-zero vector of radius + 1
bits, and each of the 2^(radius+1) - 1 non-zero directions keeps the bits whose
vector has an odd product with it. Any ``radius`` differing bits leave a
direction orthogonal to all their vectors, and in that direction's table the
two fingerprints meet: no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import free_name, in_batches, remember, settle, text_bytes

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
# Distinct fingerprints of one bucket that are compared with one another in one
# task. A larger bucket is covered anew on the bits that are still free.
TOGETHER = 4096
HASHED_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text: 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(stops)
    for low in range(0, n, HASHED_AT_ONCE):
        spans = zip(starts[low : low + HASHED_AT_ONCE], stops[low : low + HASHED_AT_ONCE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i, count in enumerate(ones.tolist()) if 2 * count > n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint as a signed long: a row for each row."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        remember(None)
        found = [fingerprint(t, shingle) for t in text_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(np.array(found, np.uint64).view(np.int64)),
            ],
            names=["doc_id", "text_hash", "fp"],
        )

    text = F.col("text").cast("string")
    plain = docs.select(
        F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash")
    )
    return plain.mapInArrow(in_batches(make), "doc_id long, text_hash long, fp long")


def covering_masks(free: list[int], radius: int) -> list[int]:
    """Masks over the bits ``free``, one for each direction."""
    directions = (1 << (radius + 1)) - 1
    vector = {bit: 1 + i % directions for i, bit in enumerate(free)}
    return [
        sum(1 << bit for bit in free if (vector[bit] & d).bit_count() & 1)
        for d in range(1, directions + 1)
    ]


def mask_levels(radius: int, together: int) -> list[list[tuple[int, int, int]]]:
    """Tables of each level as (table, table above, mask).

    A table of a level holds the bits of the one above and, of the bits still
    free, those of one direction. The last level leaves so few bits free that a
    bucket of distinct fingerprints is small.
    """
    levels: list[list[tuple[int, int, int]]] = []
    above = [(0, 0)]  # table, mask
    while True:
        level = []
        for table, mask in above:
            free = [bit for bit in range(BITS) if not mask >> bit & 1]
            for more in covering_masks(free, radius):
                level.append((len(level), table, mask | more))
        levels.append(level)
        above = [(table, mask) for table, _, mask in level]
        most_free = max(BITS - mask.bit_count() for _, _, mask in level)
        if 1 << most_free <= together or most_free <= 2 * radius + 2:
            return levels


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def star_links(bucket: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, within each bucket, what pairs in the radius join.

    ``bucket`` is sorted. Every pair of a bucket is compared; of the pairs found
    only what the components need is returned, at most a link for each row.
    """
    n = len(fp)
    parent = np.arange(n)
    at, shift = np.arange(n), 0
    while len(at):
        shift += 1
        at = at[at + shift < n]
        at = at[bucket[at] == bucket[at + shift]]
        # Unsigned: of a negative number the bits of its absolute value are counted.
        apart_bits = np.bitwise_count((fp[at] ^ fp[at + shift]).view(np.uint64))
        near = at[apart_bits <= radius]
        a, b = parent[near], parent[near + shift]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            a, b = parent[a], parent[b]
    other = np.flatnonzero(parent != np.arange(n))
    return fp[parent[other]], fp[other]


def _links_in(rows: DataFrame, radius: int) -> DataFrame:
    """Links between the fingerprints of each (table, key), all in one task."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 3), np.int64)

        def linked(block: np.ndarray) -> pa.RecordBatch:
            new = (block[1:, :2] != block[:-1, :2]).any(axis=1)
            bucket = np.append(0, np.cumsum(new)) if len(block) else np.zeros(0, np.int64)
            a, b = star_links(bucket, block[:, 2], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            block = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            block = np.concatenate([rest, block.astype(np.int64)])
            # The last bucket may go on in the next batch.
            last = (block[:, :2] == block[-1, :2]).all(axis=1)
            rest = block[last]
            yield linked(block[~last])
        yield linked(rest)

    dealt = rows.select(F.col("tbl").cast("long"), "key", "fp").repartition("tbl", "key")
    return dealt.sortWithinPartitions("tbl", "key", "fp").mapInArrow(compare, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, together: int = TOGETHER) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within the radius.

    ``fps`` has one column ``fp`` without repeats.
    """
    spark = fps.sparkSession
    levels = mask_levels(radius, together)
    tables = [
        F.struct(F.lit(t).alias("tbl"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, _, m in levels[0]
    ]
    rows = fps.select("fp", F.inline(F.array(*tables)))
    found = None
    for depth in range(len(levels)):
        sizes = rows.groupBy("tbl", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = rows.join(sizes, ["tbl", "key"])
        last = depth + 1 == len(levels)
        own = _links_in(shared if last else shared.where(F.col("n") <= together), radius)
        found = own if found is None else found.unionByName(own)
        if last:
            return found
        # 15, 225, 3375 rows: the number of tables does not depend on the data.
        below = spark.createDataFrame(
            [(t, above, _signed(m)) for t, above, m in levels[depth + 1]],
            "tbl int, above int, mask long",
        )
        crowded = shared.where(F.col("n") > together).select("fp", F.col("tbl").alias("above"))
        rows = crowded.join(F.broadcast(below), "above").select(
            "fp", "tbl", F.col("fp").bitwiseAND(F.col("mask")).alias("key")
        )
    raise AssertionError


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, together: int = TOGETHER
) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, fingerprint, component_id.

    ``component_id`` is the smallest id that a document reaches over links, its
    own included. A null text counts as empty; texts without words share the
    fingerprint 0 and are linked like any others. Repeated rows are rows of one
    group; a null id is kept and is never a component's id unless the component has
    no other. An empty table gives no rows; other columns are ignored.
    """
    found = _grouped(docs, shingle, radius, together)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", shown, "component_id")


def _grouped(docs: DataFrame, shingle: int, radius: int, together: int) -> DataFrame:
    """doc_id, text_hash, fp, label (a fingerprint of the component), component_id."""
    own = settle(fingerprints(docs, shingle), "fingerprints")
    distinct = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(links(distinct.select("fp"), radius, together))
    placed = distinct.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    named = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    of = placed.select("fp", "label").join(named, "label").select("fp", "label", "component_id")
    return own.join(of, "fp")


def first_of_each(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, together: int = TOGETHER
) -> DataFrame:
    """One row of each group, all columns: that of the smallest id.

    A null id is larger than any other; of rows with that id the one with the least
    hash of its text stays, and of rows that share both any one.
    """
    return first_rows(docs, _grouped(docs, shingle, radius, together))


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The first row of each ``label``; ``found`` has doc_id and text_hash of each row."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    chosen = found.groupBy("label").agg(F.min(order).alias("c")).select(
        F.col("c.doc_id").alias("_doc"), F.col("c.text_hash").alias("_hash")
    )
    name = free_name(docs, "text_hash")
    hashed = docs.withColumn(name, F.xxhash64(F.col("text").cast("string")))
    own = (hashed["doc_id"].cast("long").eqNullSafe(chosen["_doc"])) & (
        hashed[name] == chosen["_hash"]
    )
    kept = hashed.join(chosen, own, "left_semi")
    return kept.dropDuplicates(["doc_id", name]).select(*docs.columns)
