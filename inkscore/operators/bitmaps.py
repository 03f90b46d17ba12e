"""Which records of a group are there, as bitmaps: a bit for each record.

A group has one row for each 32,768 records instead of one for each record, so
holes are the complement of a few bytes, and no table of all groups with all
records is ever built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkscore.operators.skew import pair_all

# Fixed value: bits of the bitmaps that Spark's bitmap functions make.
BITS = 32_768


def record_bitmaps(df: DataFrame, by: list[str], flags: Mapping[str, Column | None]) -> DataFrame:
    """``by, _bucket`` and a bitmap for each of ``flags``: the records whose flag is true
    (None: all). Combined before it is shuffled; a record may be there repeatedly."""
    bit = F.pmod(F.col("record").cast("long"), F.lit(BITS))
    bucket = F.floor(F.col("record").cast("long") / BITS).alias("_bucket")
    made = [
        F.bitmap_construct_agg(bit if flag is None else F.when(flag, bit)).alias(name)
        for name, flag in flags.items()
    ]
    return df.where(F.col("record").isNotNull()).groupBy(*by, bucket).agg(*made)


def _bits(bitmaps: pa.Array) -> np.ndarray:
    """(rows, BITS) of 0 and 1; NULL is no record at all."""
    empty = bytes(BITS // 8)
    data = b"".join(b if b is not None else empty for b in bitmaps.to_pylist())
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")


def _compared(df: DataFrame, groups: DataFrame, records: DataFrame, flags: Mapping[str, Column | None]) -> DataFrame:
    """``groups, _bucket, wanted`` and a bitmap for each of ``flags``, for every group."""
    keys = groups.columns
    wanted = record_bitmaps(records, [], {"wanted": None})
    grid = pair_all(groups.distinct(), wanted)
    return grid.join(record_bitmaps(df, keys, flags), [*keys, "_bucket"], "left")


def _per_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A row is unpacked to 32,768 bytes a bitmap.
            for at in range(0, batch.num_rows, 256):
                yield make(batch.slice(at, 256))

    return run


def holes(df: DataFrame, groups: DataFrame, records: DataFrame, flags: Mapping[str, Column | None]) -> DataFrame:
    """``groups, record, missing``: the records of ``records`` that a group lacks in
    ``df`` under any of ``flags``, with the names of those.

    ``record`` is a whole number; rows of ``df`` for other groups or records do not count.
    """
    keys, names = groups.columns, list(flags)
    compared = _compared(df, groups, records, flags)
    whole = F.lit(True)
    for name in names:
        whole = whole & (F.col(name) == F.col("wanted"))
    broken = compared.where(~F.coalesce(whole, F.lit(False)))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        wanted = _bits(batch.column("wanted")) == 1
        lacks = [wanted & (_bits(batch.column(name)) == 0) for name in names]
        row, bit = np.nonzero(np.logical_or.reduce(lacks))
        record = batch.column("_bucket").to_numpy()[row] * BITS + bit
        which = np.stack([own[row, bit] for own in lacks], axis=1) if len(row) else np.zeros((0, len(names)), bool)
        values = np.array(names, object)[np.nonzero(which)[1]]
        offsets = np.append(0, np.cumsum(which.sum(axis=1))).astype(np.int32)
        missing = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.string()))
        own = batch.select(keys).take(pa.array(row))
        return pa.RecordBatch.from_arrays([*own.columns, pa.array(record), missing], names=[*keys, "record", "missing"])

    more = [T.StructField("record", T.LongType()), T.StructField("missing", T.ArrayType(T.StringType()))]
    found = broken.mapInArrow(_per_batch(make), T.StructType([*groups.schema.fields, *more]))
    return found.select(*keys, F.col("record").cast(records.schema["record"].dataType).alias("record"), "missing")


def coverage(df: DataFrame, groups: DataFrame, records: DataFrame, flags: Mapping[str, Column | None]) -> DataFrame:
    """``groups, expected``, and for each of ``flags`` how many of the expected
    records have it; ``complete`` tells whether all have all."""
    keys, names = groups.columns, list(flags)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        wanted = _bits(batch.column("wanted"))
        counts = [wanted.sum(axis=1, dtype=np.int64)]
        counts += [(wanted & _bits(batch.column(name))).sum(axis=1, dtype=np.int64) for name in names]
        own = batch.select(keys)
        return pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, counts)], names=[*keys, "expected", *names])

    schema = T.StructType([*groups.schema.fields, *[T.StructField(n, T.LongType()) for n in ("expected", *names)]])
    counted = _compared(df, groups, records, flags).mapInArrow(_per_batch(make), schema)
    sums = counted.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in ("expected", *names)])
    complete = F.lit(True)
    for name in names:
        complete = complete & (F.col(name) == F.col("expected"))
    return sums.withColumn("complete", complete)
