"""Shared folder, materialisation and batching helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.plans.session import shared_folder
from lorewell.sources.store import read_text, remove, write_text

__all__ = ["arrow_map", "hashed_sample", "materialise", "new_path", "out_batch", "read_text", "remove", "rows_at", "shared_folder", "slices", "write_text"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lorewell/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: the plan is cut, and a lost executor loses nothing. Rows of one value of `by` can be read alone."""
    path = new_path(df.sparkSession, name)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Resolution of the hash range that a sample is drawn from.
_RANGE = 1 << 40


def hashed_sample(df: DataFrame, key: str, rows: int, group: Column | None = None) -> DataFrame:
    """Up to `rows` rows, those with the smallest hashes of a unique key.

    A hash range that about 1.2 * rows of the table fall into is filtered first, so that what is
    sorted does not grow with the table or with the number of its splits. With a group, the range is
    one of groups and one of keys, so that several rows of a group are drawn together, and no group
    gives more than its share. Fewer than `rows` come out of smaller tables, or by chance.
    """
    share = (1.2 * rows + 8 * rows**0.5 + 8) / max(df.count(), 1)
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(_RANGE))
    near = df
    if share < 1 and group is None:
        near = df.where(at(F.col(key)) < int(share * _RANGE))
    elif share < 1:
        side = int(share**0.5 * _RANGE)
        near = df.where((at(F.col(key)) < side) & (at(F.coalesce(group, F.col(key).cast("string"))) < side))
    return near.orderBy(at(F.col(key)), key).limit(rows)


#: Rows that are chosen by number are told to the workers up to so many, and joined beyond it.
BROADCAST_ROWS = 2_000_000


def rows_at(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key is among those of `wanted` (one column, the key, without repeats). Few keys, by count, spare the shuffle of df."""
    few = wanted.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(wanted) if few else wanted, key, "left_semi")


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about `chars` bytes of the text column (at least one row).

    Bounds the worker's memory by the text at hand, not by the number of rows.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lens):
            if total and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def arrow_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def out_batch(columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
