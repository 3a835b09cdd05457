"""Problem 7: splitting oversized items at natural boundaries, range by range.

Cuts do not depend on one another: with step = (limit - overlap) * 2 / 3 and slack = step / 2,
cut j is the strongest boundary among the last `slack` characters before j * step (the latest
of equals; j * step itself where there is none). Two neighbouring cuts are then at most
limit - overlap apart, so a piece, which starts `overlap` characters before the previous cut,
never passes the limit. A worker that sees a range and a halo before it therefore emits the
pieces that end in its range, and no one ever loads a whole item.

In tables a window without a boundary is not cut at its end: the cut goes to the boundary nearest
to it among all within limit - overlap of the previous cut, and lies mid-text only where there is
none. Such a cut depends on the one before, so the ranges of a row, which lie one after the other
in one task, hand on their last cut. Files still cut such windows at j * step: their ranges are
bytes and read in any order: a first pass counts the characters of each range, their prefix sums place every range
in the file, and the second pass emits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import out_batch
from .kernels import code_points

LIMIT, OVERLAP = 2000, 20

#: Characters (table) and bytes (files) of a range.
RANGE_CHARS, RANGE_BYTES = 1 << 18, 1 << 24


@functools.cache
def _classes() -> np.ndarray:
    """Code point -> 1 space, 2 clause mark, 3 sentence mark that needs a space after it, 4 one that does not, 5 line end, 9 combining mark."""
    table = np.zeros(0x110000, np.uint8)
    for pattern, value in ((r"\s", 1), (r"[,;:，；：、]", 2), (r"[.!?]", 3), (r"[。！？]", 4), (r"[\n\r  ]", 5), (r"\p{M}", 9)):
        for m in regex.finditer(pattern, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))):
            table[ord(m[0])] = value
    return table


def boundary_strength(cps: np.ndarray) -> np.ndarray:
    """For each i, how natural a cut after character i is: 6 blank line, 5 line, 4 sentence, 2 clause, 1 word, 0 none, -1 before a combining mark or within a line end."""
    if not len(cps):
        return np.zeros(0, np.int8)
    c = _classes()[cps]
    after = np.append(c[1:], 5)
    s = np.zeros(len(c), np.int8)
    s[c == 1] = 1
    s[(c == 2) & (cps > 0x7F) | (c == 2) & (after == 1)] = 2
    s[c == 4] = 4
    end = (c[:-1] == 3) & (c[1:] == 1)
    s[1:][end] = 4
    s[c == 5] = 5
    pair = (cps == 13) & (np.append(cps[1:], 0) == 10)  # one line end of two characters
    second = np.concatenate(([False], pair[:-1]))
    before = np.concatenate(([0], c[:-1]))
    s[(c == 5) & (np.where(second, np.concatenate(([0], before[:-1])), before) == 5)] = 6
    s[(after == 9) | pair] = -1
    return s


def geometry(limit: int, overlap: int) -> tuple[int, int]:
    """(step, slack) of the cut windows."""
    if not 0 <= overlap < limit - 2:
        raise ValueError("overlap must be smaller than the limit")
    slack = max((limit - overlap) // 3, 1)
    return limit - overlap - slack, slack


def halo(limit: int, overlap: int) -> int:
    """Characters before a range that its worker needs: the previous cut's window, the overlap and two for context."""
    step, slack = geometry(limit, overlap)
    return step + slack + overlap + 3


def pieces_of_range(cps: np.ndarray, base: int, lo: int, hi: int, total: int, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(piece number, start, end) of the pieces whose cut point lies in (lo, hi], and of the last piece if hi = total.

    cps are the item's characters from offset `base` on; offsets count from the item's start.
    """
    step, slack = geometry(limit, overlap)
    last = -(-total // step) - 1  # number of cuts
    first_j, last_j = lo // step + 1, min(hi // step, last)
    js = np.arange(max(first_j - 1, 1), last_j + 1)
    cuts = {0: 0}
    if len(js):
        strength = boundary_strength(cps)
        win = (js * step)[:, None] - 1 - np.arange(slack)[None, :]  # character before the cut, latest first
        best = strength[np.clip(win - base, 0, len(cps) - 1)].argmax(axis=1)
        flat = strength[np.clip(win - base, 0, len(cps) - 1)][np.arange(len(js)), best] <= 0
        at = js * step - best
        at[flat & (strength[np.clip(js * step - 1 - base, 0, len(cps) - 1)] == 0)] = (js * step)[flat & (strength[np.clip(js * step - 1 - base, 0, len(cps) - 1)] == 0)]
        cuts |= dict(zip(js.tolist(), at.tolist(), strict=True))
    out = [(j - 1, max(cuts[j - 1] - overlap, 0) if j > 1 else 0, cuts[j]) for j in range(first_j, last_j + 1)]
    if hi >= total and total > 0:
        prev = cuts.get(last)
        out.append((last, max(prev - overlap, 0) if last else 0, total))
    return out


def cut_after(cut: int, strength: np.ndarray, base: int, total: int, limit: int, overlap: int) -> int | None:
    """The cut that follows `cut` (0 at the start), None where the rest is the last piece.

    strength[i] belongs to the item's character base + i, and reaches to cut + limit - overlap or the item's end.
    """
    step, slack = geometry(limit, overlap)
    end = -(-(cut + slack) // step) * step
    if end >= total:
        return None
    window = strength[end - slack - base : end - base][::-1]  # latest first
    best = int(window.argmax())
    if window[best] > 0:
        return end - best
    if total - cut <= limit - overlap:
        return None
    ahead = np.flatnonzero(strength[cut - base : cut - base + limit - overlap] > 0) + cut + 1
    if len(ahead):
        return int(ahead[np.abs(ahead - end).argmin()])
    return end if window[0] == 0 else end - best


def pieces_in_order(cps: np.ndarray, base: int, hi: int, total: int, limit: int, overlap: int, no: int, cut: int) -> tuple[list[tuple[int, int, int]], int, int]:
    """The pieces from piece `no`, which follows `cut`, on whose ends the characters before hi decide; and the number and cut to go on with."""
    strength, out = boundary_strength(cps), []
    while cut < total and (hi >= total or cut + limit - overlap <= hi):
        end = cut_after(cut, strength, base, total, limit, overlap) or total
        out.append((no, max(cut - overlap, 0), end))
        no, cut = no + 1, end
    return out, no, cut


def split_table(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Pieces of the rows whose text is longer than the limit: key, piece_no, start, end, piece.

    Null texts and texts within the limit give no piece. Offsets and lengths count code points.
    """
    back = halo(limit, overlap)
    ranges = (
        df.select(F.col(key).alias("_key"), F.col(text).alias("_t"), F.length(text).cast("long").alias("_n"))
        .where(F.col("_n") > limit)
        .select("_key", "_t", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(range_chars).cast("long"))).alias("_lo"))
        .withColumn("_base", F.greatest(F.col("_lo") - back, F.lit(0).cast("long")))
        .select("_key", "_n", "_lo", "_base", F.substring(F.col("_t"), (F.col("_base") + 1).cast("int"), (F.col("_lo") + range_chars + 1 - F.col("_base")).cast("int")).alias("_part"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = cut = 0
        for batch in batches:
            keys, out = batch.column("_key"), {"i": [], "piece_no": [], "start": [], "end": [], "piece": []}
            parts = batch.column("_part").to_pylist()
            for i, (part, n, lo, base) in enumerate(zip(parts, *(batch.column(c).to_pylist() for c in ("_n", "_lo", "_base")), strict=True)):
                cps = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
                # the ranges of a row follow one another, over batches too
                pieces, no, cut = pieces_in_order(cps, base, min(lo + range_chars, n), n, limit, overlap, no if lo else 0, cut if lo else 0)
                for k, a, b in pieces:
                    for c, v in zip(out, (i, k, a, b, part[a - base : b - base]), strict=True):
                        out[c].append(v)
            at = pa.array(out.pop("i"), pa.int64())
            yield out_batch({key: keys.take(at), "piece_no": pa.array(out["piece_no"], pa.int64()), "start": pa.array(out["start"], pa.int64()), "end": pa.array(out["end"], pa.int64()), "piece": pa.array(out["piece"], pa.string())})

    kind = df.schema[key].dataType.simpleString()
    return ranges.mapInArrow(run, f"`{key}` {kind}, piece_no bigint, start bigint, end bigint, piece string")


def _open(path: str):
    """A seekable binary file on any file system that pyarrow knows by URI (or a plain path)."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def _continuation(raw: np.ndarray) -> np.ndarray:
    return (raw & 0xC0) == 0x80


def split_files(spark: SparkSession, files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of UTF-8 files: path, piece_no, start, end (characters), piece.

    `files` has path STRING and length BIGINT, as the binaryFile source gives without its content.
    Files within the limit come out as one piece; empty files give none. Undecodable bytes
    count as one character each and come out as U+FFFD.
    """
    back = 4 * halo(limit, overlap)
    ranges = files.where("length > 0").select(
        "path", F.col("length").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("b0")
    )
    ranges = ranges.repartition(max(spark.sparkContext.defaultParallelism, 1), "path", "b0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for path, size, b0 in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "b0")), strict=True):
                with _open(path) as f:
                    f.seek(b0)
                    n.append(int((~_continuation(np.frombuffer(f.read(min(range_bytes, size - b0)), np.uint8))).sum()))
            yield out_batch({c: batch.column(c) for c in ("path", "size", "b0")} | {"n_chars": pa.array(n, pa.int64())})

    counted = ranges.mapInArrow(count, "path string, size bigint, b0 bigint, n_chars bigint")
    # one row a range: a file of 1 TB has 65,536 of them
    w = W.partitionBy("path")
    placed = counted.select(
        "path", "size", "b0", (F.sum("n_chars").over(w.orderBy("b0")) - F.col("n_chars")).alias("lo"), "n_chars", F.sum("n_chars").over(w).alias("total")
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, b0, lo, n, total in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "b0", "lo", "n_chars", "total")), strict=True):
                with _open(path) as f:
                    from_byte = max(b0 - back, 0)
                    f.seek(from_byte)
                    raw = f.read(min(b0 + range_bytes + 8, size) - from_byte)
                arr = np.frombuffer(raw, np.uint8)
                skip = 0
                while from_byte and skip < 4 and skip < len(arr) and _continuation(arr[skip : skip + 1])[0]:
                    skip += 1
                before = int((~_continuation(arr[skip : b0 - from_byte])).sum())
                # one code point a leading byte, so that offsets agree with the counts
                lead = np.flatnonzero(~_continuation(arr[skip:])) + skip
                text = raw[skip:].decode("utf-8", "replace")
                if len(text) != len(lead):
                    text = "".join(c[:1] or "�" for c in (raw[a:b].decode("utf-8", "replace") for a, b in zip(lead, [*lead[1:], len(raw)], strict=True)))
                cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                base = lo - before
                rows = [(no, a, b, text[a - base : b - base]) for no, a, b in pieces_of_range(cps, base, lo, lo + n, total, limit, overlap)] if total > limit else [(0, 0, total, text[:total])] * (b0 == 0)
                yield out_batch(
                    {"path": pa.array([path] * len(rows), pa.string())}
                    | {c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("piece_no", "start", "end"))}
                    | {"piece": pa.array([r[3] for r in rows], pa.string())}
                )

    return placed.mapInArrow(emit, "path string, piece_no bigint, start bigint, end bigint, piece string")


def found(chunks: DataFrame) -> DataFrame:
    """(pos) of the rows that had to be split."""
    return split_table(chunks.select("pos", "chunk"), "pos", "chunk").where("piece_no = 0").select("pos")
