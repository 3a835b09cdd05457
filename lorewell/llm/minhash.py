"""Min-hash signatures of shingle sets by one permutation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels as K


def signatures(sets: np.ndarray, cuts: np.ndarray, bins: int) -> np.ndarray:
    """One min-hash per bin for each set, by one permutation.

    The smallest hash of each bin counts; an empty bin borrows from a bin that a fixed sequence
    names, the same for all sets, which keeps the chance of agreement at the Jaccard similarity.
    """
    rows = len(cuts) - 1
    out = np.zeros((rows, bins), np.uint64)
    full = np.zeros((rows, bins), bool)
    row = np.repeat(np.arange(rows), np.diff(cuts))
    slot = ((sets >> np.uint64(12)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    cell = row * bins + slot
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    out.reshape(-1)[cell[first]] = K.mix(sets[first] + np.uint64(1))
    full.reshape(-1)[cell[first]] = True
    # rows are worked on as long as they have empty bins
    at = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    own, mins, have = full[at], out[at], full[at]
    turn = 0
    while len(at) and turn < 40 * bins:
        turn += 1
        donor = (K.mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) % np.uint64(bins)).astype(np.int64)
        r, c = np.nonzero(~have & own[:, donor])
        mins[r, c] = mins[r, donor[c]] + np.uint64(turn)
        have[r, c] = True
        done = have.all(axis=1)
        if done.any() or turn == 40 * bins:
            out[at] = mins
            at, own, mins, have = at[~done], own[~done], mins[~done], have[~done]
    return K.mix(out)


def min_bits(sets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """64 one-bit min-hashes of each set in one number: two sets agree in a bit with chance (1 + Jaccard) / 2."""
    bits = signatures(sets, cuts, 64) & np.uint64(1)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


#: Bins of the sized bits, those of them in the first word, and the base of their size classes.
BINS, _FIRST, _BASE = 120, 56, 1.05


def sized_bits(sets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """120 one-bit min-hashes of each set in two words: 56 below its size class (the logarithm of its size to base 1.05, in the highest byte), 64 in the second."""
    bits = signatures(sets, cuts, BINS) & np.uint64(1)
    size = np.minimum(np.log(np.maximum(np.diff(cuts), 1)) / math.log(_BASE), 255).astype(np.uint64)
    packed = lambda b: (b << np.arange(b.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return packed(bits[:, :_FIRST]) | (size << np.uint64(_FIRST)), packed(bits[:, _FIRST:])


def bits_apart(threshold: float) -> list[int]:
    """By the smaller size class, how many bits of a pair at the threshold may differ.

    Bits differ with chance (1 - threshold) / 2 there; up to four and a half standard deviations more pass,
    where a set of n fills about 120 * (1 - exp(-n / 120)) of the bins.
    """
    p = (1 - threshold) / 2
    return [math.floor(BINS * p + 4.5 * math.sqrt(BINS * p * (1 - p) / (1 - math.exp(-(_BASE**c) / BINS)))) for c in range(256)]


def may_reach(a: Column, more_a: Column, b: Column, more_b: Column, threshold: float) -> Column:
    """Whether two sized bits allow the similarity: sizes may differ by the threshold, bits by bits_apart(). Limits are looked up, as this is asked for every meeting."""
    ca, cb = F.shiftrightunsigned(a, _FIRST).cast("int"), F.shiftrightunsigned(b, _FIRST).cast("int")
    apart = F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit((1 << _FIRST) - 1))) + F.bit_count(more_a.bitwiseXOR(more_b))
    limits = F.array(*map(F.lit, bits_apart(threshold)))
    return (F.abs(ca - cb) <= math.ceil(math.log(1 / threshold) / math.log(_BASE)) + 1) & (apart <= F.get(limits, F.least(ca, cb)))
