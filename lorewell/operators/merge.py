"""Upsert, keep-first and score-keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """One row per key: the first position, the values of the last. Rows with a null key are left out.

    Two aggregates over one shuffle with map-side combine; a key that holds a third of the rows
    sends one row a task.
    """
    values = [c for c in rows.columns if c not in (key, pos)]
    last = F.max_by(F.struct(*values), F.col(pos)).alias("_last")
    merged = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(pos).alias(pos), last)
    return merged.select(key, pos, *(F.col("_last")[c].alias(c) for c in values))


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by `order`, by aggregation rather than a window. Null is a key like any other."""
    values = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*values), F.col(order)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, *(F.col("_first")[c].alias(c) for c in values))


def collapse_scores(rows: DataFrame, score: str, ordinal: str, by: list[str] | None = None) -> DataFrame:
    """Items of equal score collapse into the one with the last ordinal."""
    return rows.groupBy(*(by or []), score).agg(F.max(ordinal).alias(ordinal))


def best(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rk") -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts each partition to k before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def joined_text(rank: Column, text: Column, separator: str) -> Column:
    """The texts of a group in the order of their rank, as one string. For groups that a top-k has bounded."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), text.alias("t")))), lambda x: x["t"]), separator)
