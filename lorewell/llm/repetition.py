"""Problem 10: share of repeated content within each document.

Each document gets statistics of its repetition (STATISTICS below), each over the whole text.
Boosted trees, fitted in the run on a bounded sample of documents labelled by the exact
definition and constrained to rise with every repetition statistic, score them from flat node
arrays, all rows of a batch at a time. One of the statistics, "most", is an upper bound of the
share. So the constraint gives a score below which no case can lie, whatever the trees learned:
the least score of any document whose upper bound reaches SHARE (`least_score`). Documents at
or above it are measured exactly; the others are proven to be no cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import trees
from .common import hashed_sample, out_batch, slices

RUN, SHARE = 20, 0.3

#: Documents that the trees are fitted on, drawn by a hash of the id.
SAMPLE_ROWS = 3000

STATISTICS = [
    "log_letters",  # log(1 + letters and digits)
    "runs",  # share of runs of 20 that occurred before
    "anchored_short",  # share of anchor runs of 10 (the lowest eighth of hashes) that occurred before
    "lines",  # share of letters in lines that occurred before
    "sentences",  # share of letters in sentences that occurred before
    "most_frequent",  # share of the anchors held by the most frequent one
    "letters_kinds",  # distinct letters / letters
    "most",  # upper bound of the share: every run that occurred before repeats at most RUN positions
]
MONOTONE = {STATISTICS.index(s): 1 for s in ("runs", "anchored_short", "lines", "sentences", "most_frequent", "most")}
FREE = [f for f in range(len(STATISTICS)) if f not in MONOTONE]


def repeated_share(codes: np.ndarray, run: int = RUN) -> float:
    """Share of positions that lie in a run of `run` codes that also began earlier; 0.0 for shorter texts."""
    n = len(codes)
    if n <= run:
        return 0.0
    h = K.mix(K.rolling(codes, run))
    if n < 1 << 20:
        key = np.sort((h & np.uint64(~((1 << 20) - 1) & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64))
        again = (key[1:] & np.uint64((1 << 20) - 1))[(key[1:] ^ key[:-1]) < np.uint64(1 << 20)].astype(np.int64)
    else:
        order = np.argsort(h, kind="stable")
        again = order[1:][h[order][1:] == h[order][:-1]]
    if not len(again):
        return 0.0
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    return float((np.cumsum(edge[:-1]) > 0).mean())


def shares(codes: np.ndarray, off: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.array([repeated_share(codes[off[i] : off[i + 1]]) for i in rows], float)


def run_share(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per row: share of its runs of 20 that occurred before in the row; 0 only where none did."""
    _, cuts = K.shingle_sets(codes, off, RUN)
    total = np.maximum(np.diff(off) - RUN + 1, 0)
    return np.where(total > 0, 1 - np.diff(cuts) / np.maximum(total, 1), 0.0)


def exact_shares(codes: np.ndarray, off: np.ndarray, again: np.ndarray) -> np.ndarray:
    """repeated_share of every row; rows without a run that occurred before (`again`, their run_share, is 0) have 0.0."""
    out = np.zeros(len(again))
    at = np.flatnonzero(again > 0)
    out[at] = shares(codes, off, at)
    return out


def _repeats(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: summed weight of values that occurred before in the row, of all values, and of the most frequent value."""
    key = (row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    order = np.argsort(key)
    key, w = key[order], weight[order].astype(float)
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    r = (key >> np.uint64(44)).astype(np.int64)
    total = np.bincount(r, w, minlength=n_rows)
    again = np.bincount(r, np.where(first, 0, w), minlength=n_rows)
    most = np.zeros(n_rows)
    if len(key):
        at = np.flatnonzero(first)
        np.maximum.at(most, r[at], np.add.reduceat(w, at))
    return again, total, most


def _segments(texts: pa.Array, marks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, letters) of the pieces of each text between the given ASCII marks and CJK full stops, with letters folded."""
    cps, off = K.code_points(texts)
    folded = K.fold_table()[cps]
    cut = np.zeros(len(cps) + 1, bool)
    for m in [*marks, 0x3002, 0xFF01, 0xFF1F]:
        cut[1:] |= cps == m
    cut[off[:-1]] = True
    cut = cut[: len(cps)]
    if not len(cps):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z
    starts = np.flatnonzero(cut)
    seg = np.cumsum(cut) - 1
    keep = folded != 0
    n = np.bincount(seg[keep], minlength=len(starts))
    seg_off = np.concatenate(([0], np.cumsum(n)))
    h = K.text_keys(folded[keep], seg_off)
    row = np.searchsorted(off, starts, "right") - 1
    some = n > 0
    return row[some], h[some], n[some]


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one row of STATISTICS per text, folded codes, offsets)."""
    codes, off = K.fold(texts)
    n, rows = np.diff(off), len(off) - 1
    out = np.zeros((rows, len(STATISTICS)))
    out[:, 0] = np.log1p(n)
    out[:, 1] = run_share(codes, off)
    out[:, 7] = np.minimum(out[:, 1] * np.maximum(n - RUN + 1, 0) * RUN / np.maximum(n, 1), 1)
    row, _, h = K.runs(codes, off, RUN // 2)
    anchor = (h & np.uint64(7)) == 0
    again, anchors, most = _repeats(row[anchor], h[anchor], np.ones(int(anchor.sum())), rows)
    out[:, 2] = again / np.maximum(anchors, 1)
    out[:, 5] = np.where(most > 1, most, 0) / np.maximum(anchors, 1)
    for col, marks in ((3, b"\n"), (4, b".!?\n")):
        again, total, _ = _repeats(*_segments(texts, marks), rows)
        out[:, col] = again / np.maximum(total, 1)
    row = np.repeat(np.arange(rows, dtype=np.uint64), n)
    pair = np.unique((row << np.uint64(32)) | codes)
    out[:, 6] = np.bincount((pair >> np.uint64(32)).astype(np.int64), minlength=rows) / np.maximum(n, 1)
    return out, codes, off


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> trees.Forest:
    """Trees for "repeats at least 30 % of its positions", from up to sample_rows documents."""
    sample = hashed_sample(docs.select("doc_id", "text").where(F.col("text").isNotNull()), "doc_id", sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, codes, off = statistics(batch.column("text"))
            share = shares(codes, off, np.arange(len(off) - 1))
            yield out_batch({"x": pa.array(list(x), pa.list_(pa.float64())), "share": pa.array(share)})

    got = sample.mapInArrow(run, "x array<double>, share double").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit_trees(x, got.column("share").to_numpy() >= SHARE)


def _at_bound(free: np.ndarray) -> np.ndarray:
    """Statistics of the least that a case can show, for given values of the free statistics: a case has at least SHARE / RUN of its runs again."""
    x = np.zeros((len(free), len(STATISTICS)))
    x[:, FREE] = free
    x[:, STATISTICS.index("most")] = SHARE - 1e-9
    x[:, STATISTICS.index("runs")] = SHARE / RUN - 1e-9
    return x


def fit_trees(x: np.ndarray, case: np.ndarray) -> trees.Forest:
    """Trees over statistics. A fifth of the rows are added once more, moved to the least that a case can show and called cases, so that the score below which none can lie is high enough to rule documents out."""
    bound = _at_bound(x[::5][:, FREE])
    return trees.fit(np.concatenate((x, bound)), np.concatenate((case, np.ones(len(bound)))).astype(float), MONOTONE)


def measure(docs: DataFrame, forest: trees.Forest | None = None) -> DataFrame:
    """One row per document: doc_id, score (log-odds of the trees), repeated_share.

    repeated_share is exact for every text, whatever its score; empty texts have 0.0 and null texts null.
    """
    held = docs.sparkSession.sparkContext.broadcast(forest or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text = batch.column("text")
            x, codes, off = statistics(text)
            share = pa.array(exact_shares(codes, off, x[:, STATISTICS.index("runs")]), mask=text.is_null().to_numpy(zero_copy_only=False))
            yield out_batch({"doc_id": batch.column("doc_id"), "score": pa.array(held.value.score(x)), "repeated_share": share})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, repeated_share double")


def least_score(forest: trees.Forest) -> float:
    """The least score of any document that can be a case: constrained statistics at the least that a case can show, the free ones at their worst."""
    # one value on either side of every threshold
    values = [np.append(np.unique(forest.threshold[forest.feature == f]), np.inf) for f in FREE]
    grid = np.stack([v.reshape(-1) for v in np.meshgrid(*values, indexing="ij")], axis=1)
    return float(forest.score(_at_bound(grid)).min()) - 1e-9


def found(docs: DataFrame, forest: trees.Forest | None = None) -> DataFrame:
    """(doc_id) of documents with at least 30 % repeated positions: scored by the trees, then measured exactly.

    Null and short texts are no cases.
    """
    forest = forest or fit(docs)
    held = docs.sparkSession.sparkContext.broadcast((forest, least_score(forest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, least = held.value
        for batch in slices(batches, "text"):
            x, codes, off = statistics(batch.column("text"))
            at = np.flatnonzero(model.score(x) >= least)
            yield out_batch({"doc_id": batch.column("doc_id").take(pa.array(at[shares(codes, off, at) >= SHARE]))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint")
