"""Problem 8: passages of held-out items in training texts, by winnowing.

With k-runs of K letters and digits and windows of WINDOW runs, the smallest hash of each
window is kept; a shared span of K + WINDOW - 1 = 60 or more holds a whole window, whose
minimum both sides keep. Every shared fingerprint is then extended to the exact span, so the
result has neither misses nor false hits. Fingerprints of the held-out side are few; while
they stay under a checked size they travel to the workers and the corpus is read in one pass
without a shuffle, beyond it both sides' fingerprints are joined by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import out_batch, slices

SPAN = 60
RUN = 24
WINDOW = SPAN - RUN + 1

#: The held-out texts are sent to the workers up to this size (characters), and joined by hash beyond it.
BROADCAST_CHARS = 16_000_000


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over values[i : i + width] for each i (shorter at the end)."""
    cur, size, out, done = values, 1, None, 0
    while True:
        if width & 1:
            if out is None:
                out, done = cur.copy(), size
            else:
                out = out.copy()
                n = max(len(out) - done, 0)
                out[:n] = op(out[:n], cur[done : done + n])
                done += size
        width >>= 1
        if not width:
            return out
        nxt = cur.copy()
        n = max(len(cur) - size, 0)
        nxt[:n] = op(cur[:n], cur[size : size + n])
        cur, size = nxt, size * 2


def fingerprints(codes: np.ndarray, off: np.ndarray, run: int = RUN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index into codes) of the kept runs of each row.

    A run is kept if it is the smallest of some whole window of its row; equal minima are all kept.
    """
    if len(codes) < run:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = K.mix(K.rolling(codes, run))
    left = np.repeat(off[1:], np.diff(off))[: len(h)] - np.arange(len(h))  # codes left in the row
    h = np.where(left >= run, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    low = _sliding(h, window, np.minimum)
    low[left < run + window - 1] = 0
    # position i is in the windows that start at i - window + 1 .. i
    high = _sliding(low[::-1], window, np.maximum)[::-1]
    kept = np.flatnonzero((high == h) & (left >= run))
    return h[kept], kept


def spans(doc: np.ndarray, doc_off: np.ndarray, item: np.ndarray, item_off: np.ndarray, at: np.ndarray, item_at: np.ndarray, doc_row: np.ndarray, item_row: np.ndarray, span: int = SPAN, run: int = RUN) -> np.ndarray:
    """Whether the match of run codes at (at, item_at) lies in a common span of at least `span` codes."""
    reach = np.arange(run - span, span)
    ok = np.zeros(len(at), bool)
    for lo in range(0, len(at), 20_000):
        sl = slice(lo, lo + 20_000)
        d, i = at[sl, None] + reach, item_at[sl, None] + reach
        inside = (d >= doc_off[doc_row[sl], None]) & (d < doc_off[doc_row[sl] + 1, None]) & (i >= item_off[item_row[sl], None]) & (i < item_off[item_row[sl] + 1, None])
        same = inside & (doc[np.clip(d, 0, len(doc) - 1)] == item[np.clip(i, 0, len(item) - 1)])
        total = np.concatenate((np.zeros((len(same), 1), np.int32), np.cumsum(same, axis=1, dtype=np.int32)), axis=1)
        ok[sl] = ((total[:, span:] - total[:, :-span]) == span).any(axis=1)
    return ok


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) for every index in lo[row] : hi[row]."""
    n = hi - lo
    row = np.repeat(np.arange(len(lo)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _direct(docs: DataFrame, items: DataFrame) -> DataFrame:
    rows = items.select("item_id", "text").toArrow()  # bounded by BROADCAST_CHARS, checked by the caller
    item_ids = rows.column("item_id").to_numpy()
    codes, off = K.fold(pa.concat_arrays(rows.column("text").chunks) if rows.num_rows else pa.array([], pa.string()))
    h, at = fingerprints(codes, off)
    order = np.argsort(h, kind="stable")
    held = docs.sparkSession.sparkContext.broadcast((item_ids, codes, off, h[order], at[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item, item_off, ih, iat = held.value
        for batch in slices(batches, "text"):
            doc, doc_off = K.fold(batch.column("text"))
            dh, dat = fingerprints(doc, doc_off)
            lo, hi = np.searchsorted(ih, dh, "left"), np.searchsorted(ih, dh, "right")
            hit, j = _expand(lo, hi)
            at, item_at = dat[hit], iat[j]
            d_row, i_row = np.searchsorted(doc_off, at, "right") - 1, np.searchsorted(item_off, item_at, "right") - 1
            good = spans(doc, doc_off, item, item_off, at, item_at, d_row, i_row) if len(at) else np.zeros(0, bool)
            pairs = np.unique(np.stack((d_row[good], i_row[good])), axis=1)
            yield out_batch({"doc_id": batch.column("doc_id").take(pa.array(pairs[0])), "item_id": pa.array(ids[pairs[1]].astype(np.int64))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint")


def fingerprint_table(df: DataFrame, key: str) -> DataFrame:
    """(hash, key): one row per kept fingerprint of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes, off = K.fold(batch.column("text"))
            h, at = fingerprints(codes, off)
            row = np.searchsorted(off, at, "right") - 1
            pair = np.unique(np.stack((row.astype(np.uint64), h)), axis=1)
            yield out_batch({"hash": K.signed(pair[1].copy()), key: batch.column(key).take(pa.array(pair[0].astype(np.int64)))})

    return df.select(key, "text").mapInArrow(run, f"hash bigint, `{key}` bigint")


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    pairs = fingerprint_table(docs, "doc_id").join(fingerprint_table(items, "item_id"), "hash").select("doc_id", "item_id").distinct()
    both = pairs.join(items.select("item_id", F.col("text").alias("item_text")), "item_id").join(docs.select("doc_id", "text"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            doc, doc_off = K.fold(batch.column("text"))
            item, item_off = K.fold(batch.column("item_text"))
            (dh, dat), (ih, iat) = fingerprints(doc, doc_off), fingerprints(item, item_off)
            d_row, i_row = (np.searchsorted(o, a, "right") - 1 for o, a in ((doc_off, dat), (item_off, iat)))
            # row number in the high bits, so that only the two texts of one row meet
            tag = lambda h, row: (h >> np.uint64(20)) | (row.astype(np.uint64) << np.uint64(44))
            it = tag(ih, i_row)
            order = np.argsort(it, kind="stable")
            dt = tag(dh, d_row)
            hit, j = _expand(np.searchsorted(it[order], dt, "left"), np.searchsorted(it[order], dt, "right"))
            at, item_at, row = dat[hit], iat[order][j], d_row[hit]
            good = np.unique(row[spans(doc, doc_off, item, item_off, at, item_at, row, row)]) if len(at) else np.zeros(0, np.int64)
            yield batch.select(["doc_id", "item_id"]).take(pa.array(good))

    return both.mapInArrow(run, "doc_id bigint, item_id bigint")


def found(docs: DataFrame, items: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id) of every document and item with at least 60 consecutive letters and digits in common.

    Null and short texts on either side match nothing; without items the result is empty.
    """
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return _direct(docs, items) if size <= broadcast_chars else _joined(docs, items)


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item that leaked: item_id, the number of documents that hold it, the smallest such doc_id."""
    return found(docs, items).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc_id"))
