"""Helpers that several operators of this package use.

Words are runs of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return, which is just what ``bytes.split()`` splits at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..session import checkpoint_dir

MASK64 = (1 << 64) - 1
# Of whole texts, and what is made of them, a worker of the pipeline gets so much at once.
BATCH_BYTES = "4m"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and
    a lost executor costs no recomputation of what came before."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.settled_at = path
    return read


def free(*tables: DataFrame) -> None:
    """Removes settled tables that nothing will read again."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table.settled_at)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds


def fold_of(identity: int | None, folds: int) -> int:
    import zlib

    return zlib.crc32(b"" if identity is None else str(identity).encode()) % folds


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text, b'' for null."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def in_small_batches(spark: SparkSession) -> None:
    """Bounds the batches of whole texts on their way to Python workers and back."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


# What an operator remembers in this Python worker from batch to batch.
_REMEMBERED: list[dict] = []


def remember(memory: dict | None) -> None:
    """A worker serves one operator after the other: what another one remembered is let go."""
    if _REMEMBERED and _REMEMBERED[0] is not memory:
        _REMEMBERED.pop().clear()
    if memory is not None and not _REMEMBERED:
        _REMEMBERED.append(memory)


def in_batches(
    make: Callable[[pa.RecordBatch], pa.RecordBatch | None],
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow from one that turns a batch into a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = make(batch)
                if made is not None and made.num_rows:
                    yield made

    return run


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, remembered for at most ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if self is WORD_HASHES:
            remember(self)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORD_HASHES = WordHashes()


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a longer name where the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def with_column(
    df: DataFrame,
    name: str,
    kind: DataType,
    make: Callable[[list[str | None]], pa.Array],
) -> DataFrame:
    """``df`` with a column made from its texts, batch by batch, in place."""
    at = [c.lower() for c in df.columns].index("text")

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = make(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    schema = StructType([*df.schema.fields, StructField(name, kind)])
    return df.mapInArrow(in_batches(add), schema)
