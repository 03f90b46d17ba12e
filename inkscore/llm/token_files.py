"""Token ids in Arrow stream files of equal-length sequences.

A file is an Arrow IPC stream of record batches with two fixed-size-list
columns, ``ids`` and ``mask``. All batches but the last hold the same number of
sequences, so a sequence's place follows from its number, and a mapped file is
read without a copy. Tokens of a file run on from sequence to sequence; only
the end of the last one is padding, where the mask is false. The files, in
ascending order of their number, hold the documents in ascending id order.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import settle, shared_folder

SEQUENCE = 1024
IN_BATCH = 256
BYTES_IN_FILE = 24_000_000
INDEX = pa.schema(
    [("doc_id", pa.int64()), ("file", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64())]
)


def filesystem(path: str):
    """The file system of ``path`` and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def file_name(folder: str, number: int) -> str:
    return f"{folder}/tokens-{number:06d}.arrow"


class TokenWriter:
    """Writes one file; it appears under its name only when complete."""

    def __init__(self, folder: str, number: int, sequence: int, in_batch: int, kind: type):
        self.fs, self.path = filesystem(file_name(folder, number))
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{os.getpid()}-{os.urandom(4).hex()}"
        self.sequence, self.kind = sequence, np.dtype(kind)
        self.block = sequence * in_batch
        ids = pa.list_(pa.field("item", pa.from_numpy_dtype(self.kind), False), sequence)
        mask = pa.list_(pa.field("item", pa.bool_(), False), sequence)
        self.schema = pa.schema([("ids", ids), ("mask", mask)])
        self.sink = self.fs.open_output_stream(self.part)
        self.writer = pa.ipc.new_stream(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.n = 0

    def add(self, ids: np.ndarray) -> int:
        """Appends ids; returns the place of the first one in the file."""
        at = self.n
        self.n += len(ids)
        self.waiting.append(ids.astype(self.kind))
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            self._flush(self.n_waiting // self.block * self.block)
        return at

    def _flush(self, count: int) -> None:
        data = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind)
        self.waiting = [data[count:]]
        self.n_waiting = len(data) - count
        for low in range(0, count, self.block):
            own = data[low : min(low + self.block, count)]
            rows = -(-len(own) // self.sequence)
            ids = np.zeros(rows * self.sequence, self.kind)
            ids[: len(own)] = own
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(values), type=field.type)
                for values, field in zip((ids, np.arange(len(ids)) < len(own)), self.schema)
            ]
            self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(self.n_waiting)
        self.writer.close()
        self.sink.close()
        self.fs.move(self.part, self.path)


class TokenFile:
    """Random access to one file, without a copy where the file can be mapped."""

    def __init__(self, folder: str, number: int):
        fs, path = filesystem(file_name(folder, number))
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.sequence = self.batches[0].schema.field("ids").type.list_size if self.batches else 0
        self.block = self.batches[0].num_rows * self.sequence if self.batches else 0
        self.at, self.last = -1, None

    def sequences(self, batch: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of a batch, one row a sequence; the ids are a view."""
        if batch != self.at:
            own = self.batches[batch]
            shape = (own.num_rows, self.sequence)
            ids = own.column("ids").flatten().to_numpy(zero_copy_only=True)
            mask = own.column("mask").flatten().to_numpy(zero_copy_only=False)
            self.at, self.last = batch, (ids.reshape(shape), mask.reshape(shape))
        return self.last

    def tokens(self, at: int, count: int) -> np.ndarray:
        """``count`` ids from place ``at`` of the file."""
        found = []
        while count > 0:
            ids, mask = self.sequences(at // self.block)
            low = at % self.block
            high = min(low + count, ids.size)
            if not mask.reshape(-1)[low:high].all():
                raise ValueError("a place in the padding")
            found.append(ids.reshape(-1)[low:high])
            at, count = at + high - low, count - (high - low)
        return np.concatenate(found) if found else np.zeros(0, np.uint32)


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 0,
    sequence: int = SEQUENCE,
    in_batch: int = IN_BATCH,
    files: int | None = None,
) -> DataFrame:
    """Writes the ids of all documents, each with ``end_id`` behind it.

    Returns the index: doc_id, file, at (place in the file), n_tokens. A task
    writes one file in one pass; a repeated task writes the same file again.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    if files is None:
        size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-size // BYTES_IN_FILE))
    # Ties of the id are ordered by the text, so every attempt sees one order.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    sorted_docs = plain.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        small = max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                kind = np.uint16 if small else np.uint32
                writer = TokenWriter(folder, number, sequence, in_batch, kind)
            places, counts = [], []
            for ids in encode.encode(batch.column(1).to_pylist()):
                own = np.append(np.frombuffer(ids, np.uint32), np.uint32(end_id))
                places.append(writer.add(own))
                counts.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([number] * batch.num_rows, pa.int32()),
                    pa.array(places, pa.int64()),
                    pa.array(counts, pa.int64()),
                ],
                schema=INDEX,
            )
        if writer is not None:
            writer.close()

    schema = "doc_id long, file int, at long, n_tokens long"
    return settle(sorted_docs.mapInArrow(write, schema), "token-index")


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """Each document's tokens read from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. The only window
    without a key holds one row a file.
    """
    sizes = index.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    files = max(1, sizes.count())
    placed = (
        index.join(first, "file")
        .select("doc_id", (F.col("_first") + F.col("at")).alias("start"), "file", "at", "n_tokens")
        .repartition(files, "file")
        .sortWithinPartitions("file", "at")
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, opened = None, None
        for batch in batches:
            sums = []
            for file, at, count in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                if file != number:
                    number, opened = file, TokenFile(folder, file)
                ids = opened.tokens(at, count).astype("<u4")
                sums.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return placed.mapInArrow(read, schema)


def token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, **shape: int
) -> DataFrame:
    """Writes the token files of ``docs`` and reads every document back.

    ``folder`` must be one that all workers share; left out, it is a new one in
    the session's checkpoint folder. Null text counts as empty (its end id
    alone), a null id comes first, rows with one id are ordered by their text, an
    empty table writes no file, other columns are ignored.
    """
    folder = folder or shared_folder(docs.sparkSession, "token-files")
    return read_tokens(write_tokens(docs, tokenizer, folder, end_id, **shape), folder)
