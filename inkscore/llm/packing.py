"""Best-fit-decreasing packing of token sequences.

Lengths are integers from 1 to the capacity, so the packing is decided on the
histogram of lengths (at most ``capacity`` numbers, whatever the corpus): a
segment tree over remaining capacities finds the tightest open bin, and bins
of equal content are one range. The ranges, bounded by the capacity alone, go
to the workers, where a piece finds its place by its rank among the pieces of
its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import in_batches, settle

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
# Pieces of one length that one window of ranks holds, about.
RANKED_TOGETHER = 50_000


class OpenBins:
    """Segment tree over remaining capacities: which have an open bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def mark(self, remaining: int, is_open: bool) -> None:
        node = remaining + self.size
        self.any[node] = is_open
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of ``length`` or more with an open bin."""
        node = length + self.size
        while not self.any[node]:
            while node & 1:  # a right child: nothing larger below this parent
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_ranges(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Where best-fit decreasing puts the pieces of each length.

    ``histogram`` holds the number of pieces of each length. Returns rows
    (length, first rank, pieces, first sequence, offset, pieces per sequence):
    rank ``first + i`` goes to sequence ``i // per`` from the first one, at
    ``offset + (i % per) * length``.
    """
    tree, open_bins = OpenBins(capacity), {}
    rows: list[tuple[int, ...]] = []
    sequences = 0

    def free(remaining: int, first: int, bins: int) -> None:
        if remaining and bins:
            open_bins.setdefault(remaining, []).append((first, bins))
            tree.mark(remaining, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, bins = sequences, -(-left // per)
                sequences += bins
            else:
                per = room // length
                first, bins = open_bins[room].pop()
                if not open_bins[room]:
                    tree.mark(room, False)
            used = min(bins, -(-left // per))
            placed = min(left, used * per)
            rows.append((length, rank, placed, first, capacity - room, per))
            full = placed // per
            free(room - per * length, first, full)
            if placed % per:
                free(room - placed % per * length, first + full, 1)
            free(room, first + used, bins - used)
            rank, left = rank + placed, left - placed
    return rows


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Token pieces of each document: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then ``end_id``; null text counts as empty, so it
    is the end id alone. Only a document above ``capacity`` is cut: all its
    pieces but the first are full.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        end = np.uint32(end_id).tobytes()
        rows: list[tuple] = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(texts)):
            data = memoryview(ids + end)
            n = len(data) // 4
            high = n % capacity or min(n, capacity)
            low = piece = 0
            while low < n:
                rows.append((doc_id, piece, low, high - low, zlib.crc32(data[4 * low : 4 * high])))
                low, high, piece = high, high + capacity, piece + 1
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)]
        return pa.RecordBatch.from_arrays(columns, schema=PIECES)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return plain.mapInArrow(in_batches(cut), schema)


def pack(pieces: DataFrame, capacity: int = 1024, ranked_together: int = RANKED_TOGETHER) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``.

    ``pieces`` must hold still (a settled table): it is read twice. All other
    columns stay; equal rows are separate pieces, and rows are told apart by
    all their columns, so a repeated task gives the same places.
    """
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {row["length"]: row["n"] for row in lengths.collect()}
    ranges = np.array(best_fit_ranges(histogram, capacity) or np.zeros((0, 6)), np.int64)
    chunks = max(1, -(-sum(histogram.values()) // ranked_together))
    names = pieces.columns

    chunk = F.pmod(F.xxhash64(*names), F.lit(chunks)).alias("_chunk")
    dealt = pieces.select("*", chunk)
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    first = counts.select(
        F.col("length").alias("_length"),
        F.col("_chunk").alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
    )
    order = Window.partitionBy("length", "_chunk").orderBy(*names)
    ranked = (
        dealt.withColumn("_at", F.row_number().over(order) - 1)
        .join(first, (F.col("length") == F.col("_length")) & (F.col("_chunk") == F.col("_of")))
        .select(*names, (F.col("_first") + F.col("_at")).alias("_rank"))
    )
    # Ranges ordered by (length, first rank), so one search finds the range of a piece.
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    starts = {length: int(np.searchsorted(ranges[:, 0], length)) for length in histogram}
    stops = {length: int(np.searchsorted(ranges[:, 0], length, "right")) for length in histogram}

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column("length").to_numpy()
        rank = batch.column("_rank").to_numpy()
        sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
        for one in np.unique(length).tolist():
            here, own = length == one, ranges[starts[one] : stops[one]]
            row = own[np.searchsorted(own[:, 1], rank[here], "right") - 1]
            at = rank[here] - row[:, 1]
            sequence[here] = row[:, 3] + at // row[:, 5]
            offset[here] = row[:, 4] + at % row[:, 5] * one
        kept = batch.select(names)
        return pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(sequence), pa.array(offset)],
            names=[*names, "sequence_id", "offset"],
        )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(in_batches(place), f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2
) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty
    text is its end id alone; repeated rows are separate documents; a null id
    stays null; an empty table gives no rows; of equally tight bins any one is
    taken, which changes no count of sequences.
    """
    return pack(settle(cut_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
