"""Vectorised text kernels: letters-and-digits folding, rolling hashes, shingle sets.

All of them work on the concatenation of a whole Arrow batch of texts, so that the
Python cost is a handful of numpy calls a batch and never a loop over characters.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


@functools.cache
def fold_table() -> np.ndarray:
    """Code point -> lower-cased code point of a letter or number, 0 for all others."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LN":
            table[cp] = ord(ch.lower()[0])
    return table


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array, and the offsets of its rows (null = empty)."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if texts.buffers()[2] is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
    return cps, starts[ends - ends[0]]


def fold(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits, lower-cased, of each row: code points and row offsets."""
    cps, off = code_points(texts)
    folded = fold_table()[cps]
    keep = folded != 0
    return folded[keep], np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))[off]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every run of k codes (over the concatenation), unmixed.

    Built from runs of 1, 2, 4, ... codes: log2(k) multiplications a position.
    """
    cur, cur_len = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1
    out, out_len = None, 0
    while True:
        if k & 1:
            if out is None:
                out, out_len = cur, cur_len
            else:
                n = max(min(len(out), len(cur) - out_len), 0)
                out = out[:n] * np.uint64(pow(_BASE, cur_len, 1 << 64)) + cur[out_len : out_len + n]
                out_len += cur_len
        k >>= 1
        if not k:
            return out
        n = max(len(cur) - cur_len, 0)
        cur = cur[:n] * np.uint64(pow(_BASE, cur_len, 1 << 64)) + cur[cur_len : cur_len + n]
        cur_len *= 2


def runs(codes: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, mixed hash) of each run of k codes that lies within a row."""
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(codes)) - np.repeat(off[:-1], n)
    if len(codes) < k:
        return row[:0], at[:0], np.zeros(0, np.uint64)
    m = len(codes) - k + 1
    ok = at[:m] + k <= np.repeat(n, n)[:m]
    return row[:m][ok], at[:m][ok], mix(rolling(codes, k)[:m][ok])


def shingle_sets(codes: np.ndarray, off: np.ndarray, k: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-run hashes (44 bits) of each row, ascending within the row, and row offsets.

    One sort of `row << 44 | hash` for all rows; batches of up to 2**20 rows.
    """
    row, _, h = runs(codes, off, k)
    key = (row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    cuts = np.searchsorted(key, np.arange(len(off), dtype=np.uint64) << np.uint64(44))
    return key & np.uint64((1 << 44) - 1), cuts.astype(np.int64)


def text_keys(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's code sequence.

    Sum over positions of mix(code, position): equal sequences give equal keys, and unlike
    sequences collide with a chance of about pairs / 2**64.
    """
    n = np.diff(off)
    at = (np.arange(len(codes)) - np.repeat(off[:-1], n)).astype(np.uint64)
    h = mix(codes.astype(np.uint64) * np.uint64(_BASE) ^ mix(at + np.uint64(0x51ED2701)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
    return mix((total[off[1:]] - total[off[:-1]]) ^ (n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def pair_jaccard(ha: np.ndarray, oa: np.ndarray, hb: np.ndarray, ob: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of row i of one shingle-set batch with row i of another."""
    na, nb = np.diff(oa), np.diff(ob)
    row = np.arange(len(na), dtype=np.uint64)
    key = np.concatenate(((np.repeat(row, na) << np.uint64(44)) | ha, (np.repeat(row, nb) << np.uint64(44)) | hb))
    key.sort()
    same = key[1:][key[1:] == key[:-1]] >> np.uint64(44)
    both = np.bincount(same.astype(np.int64), minlength=len(na))
    union = na + nb - both
    return np.where(union > 0, both / np.maximum(union, 1), 0.0)


def signed(h: np.ndarray) -> np.ndarray:
    """A uint64 array as int64, Spark's BIGINT."""
    return h.view(np.int64)
