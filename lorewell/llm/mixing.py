"""Problem 9: mixing sources to target weights, by weighted fair queueing.

Every source's documents queue in a shuffled order, once for each allowed repeat (the order of
a repeat is its own shuffle, and a repeat starts when the one before has ended). A document's
virtual finish time is the number of its source's tokens up to and including it, divided by
the source's weight. Sorting all documents by that time and cutting at the token budget gives
each source its weight of whatever total is reached; a source that runs out leaves its share
to the others in proportion to their weights.

Both running sums are prefix sums over a range partitioning: local sums in each task, one
offset per task (and source), no window over a whole source.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, out_batch, slices

#: Public tokenizer that sizes are counted in (ranks file of a byte-level BPE).
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the published pre-tokenisation pattern of byte-level BPE vocabularies of 50k entries.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def _encoding(path: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns `keep` and n_tokens of each text; null and empty texts have 0 tokens."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for batch in slices(batches, "_text"):
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("_text").to_pylist()]
            yield out_batch({c: batch.column(c) for c in keep} | {"n_tokens": pa.array(n, pa.int64())})

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def running_sum(df: DataFrame, order: list[str], value: str, out: str, group: str | None = None) -> DataFrame:
    """df with `out`: the sum of `value` over all rows up to and including each, in the given order (within `group`, the first of `order`).

    A range partitioning, one local running sum a task, and an offset per task (and group). The
    offsets number tasks x groups at most and are joined by task.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", _task int, `{out}` bigint"
    names = df.columns

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            s = np.cumsum(v)
            if group is None:
                s = s + total
                total = int(s[-1])
            else:
                g = np.array(batch.column(group).to_pylist(), dtype=object)
                new = np.concatenate(([g[0] != last], g[1:] != g[:-1]))
                at = np.flatnonzero(new)
                base = np.zeros(len(v), np.int64)
                for a, b in zip(at, np.append(at[1:], len(v)), strict=False):
                    base[a:b] = s[a] - v[a]
                if not new[0]:  # the batch goes on with the group before
                    base[: at[0] if len(at) else len(v)] = -total
                s = s - base
                last, total = g[-1], int(s[-1])
            yield out_batch({c: batch.column(c) for c in names} | {"_task": pa.array(np.full(len(v), task, np.int32)), out: pa.array(s)})

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # written, so that the tasks' numbers and the rows in them are the same for both uses
    part = materialise(ordered.mapInArrow(local, schema), "running-sum")
    by = ["_task"] if group is None else [group, "_task"]
    sums = part.groupBy(*by).agg(F.sum(value).alias("_sum"))
    # a global order has one offset per task; a grouped one per task and group
    w = (W.partitionBy(group) if group else W.partitionBy(F.lit(0))).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    return part.join(offsets, by).withColumn(out, F.col(out) + F.col("_offset")).drop("_task", "_offset")


def sized_sources(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Documents of the target sources with their tokens (doc_id, source, n_tokens), and the targets that have some (source, weight, repeats, total, longest).

    Weights are scaled to 1 over the sources that have tokens. Documents without tokens, with a null
    source or of a source that is no target (or has weight <= 0 or max_repeats < 1) are left out;
    a target given twice counts once, with its larger weight and number of repeats.
    """
    t = targets.where("source IS NOT NULL AND target_weight > 0 AND max_repeats >= 1").groupBy("source").agg(F.max("target_weight").alias("weight"), F.max("max_repeats").alias("repeats"))
    rows = docs.select("doc_id", "source", "text").join(t.select("source"), "source", "left_semi")
    sized = materialise(token_counts(rows, ["doc_id", "source"], tokenizer=tokenizer).where("n_tokens > 0"), "mix-tokens")
    present = t.join(sized.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.max("n_tokens").alias("longest")), "source")
    whole = present.agg(F.sum("weight")).first()[0] or 1.0
    return sized, present.select("source", (F.col("weight") / whole).alias("weight"), "repeats", "total", "longest")


def needed_repeats(present: DataFrame, budget: int) -> DataFrame:
    """The targets with `repeats` cut to what the budget can use: one more than the last repeat that begins before it is spent.

    By the virtual time at which the budget is spent: a source uses weight x time tokens until its repeats are used up,
    and lags behind that by its longest document at most.
    """
    ends = present.select("weight", "longest", (F.col("repeats") * F.col("total")).alias("most")).collect()  # one row a target source
    budget = budget + sum(r["longest"] for r in ends)
    spent, time, rate = 0.0, 0.0, sum(r["weight"] for r in ends)
    for end, weight in sorted((r["most"] / r["weight"], r["weight"]) for r in ends):
        if rate <= 0 or spent + rate * (end - time) >= budget:
            break
        spent, time, rate = spent + rate * (end - time), end, rate - weight
    else:
        return present
    time += (budget - spent) / max(rate, 1e-12)
    return present.withColumn("repeats", F.least("repeats", (F.ceil(F.col("weight") * time / F.col("total")) + 1).cast("bigint")))


def queue(sized: DataFrame, present: DataFrame, seed: int = 17) -> DataFrame:
    """One row per document and repeat: source, doc_id, repeat_no, n_tokens, weight, finish."""
    scaled = present.select("source", "weight", "repeats")
    copies = sized.join(F.broadcast(scaled), "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("repeats") - 1))).drop("repeats")
    copies = copies.withColumn("_h", F.xxhash64("doc_id", "repeat_no", F.lit(seed)))
    done = running_sum(copies, ["source", "repeat_no", "_h", "doc_id"], "n_tokens", "_sum", "source")
    return done.select("source", "doc_id", "repeat_no", "n_tokens", "weight", (F.col("_sum") / F.col("weight")).alias("finish"))


def mixture(docs: DataFrame, targets: DataFrame, budget: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """The mixture: source, doc_id, repeat_no, n_tokens, weight, finish, up to the token budget.

    The default budget is the number of tokens of all target sources, each counted once. The
    document that would pass the budget is left out, as are all after it. Repeats that the budget
    cannot reach are never made.
    """
    sized, present = sized_sources(docs, targets, tokenizer)
    present = materialise(present, "mix-targets")
    if budget is None:
        budget = present.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    line = materialise(queue(sized, needed_repeats(present, budget)), "mix-queue")
    placed = running_sum(line, ["finish", "source", "repeat_no", "doc_id"], "n_tokens", "_total")
    return placed.where(F.col("_total") <= budget).drop("_total")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: its target weight, documents, tokens, largest repeat and actual share of the mixture."""
    per = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), (F.max("repeat_no") + 1).alias("repeats_used"))
    total = mixed.agg(F.sum("n_tokens")).first()[0] or 1
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    zero = F.lit(0).cast("bigint")
    return t.join(per, "source", "left").select(
        "source",
        "target_weight",
        "max_repeats",
        F.coalesce("n_docs", zero).alias("n_docs"),
        F.coalesce("n_tokens", zero).alias("n_tokens"),
        F.coalesce("repeats_used", zero).alias("repeats_used"),
        F.coalesce(F.col("n_tokens") / total, F.lit(0.0)).alias("actual_share"),
    )
