"""Problem 1: keeping only the main body of web pages, with a recurrent line labeller.

A page is a sequence of its non-blank lines. Each line is read as a vector of its shape (what a
tag path would tell: markers, separators, length, case, endings, place on the page) and the sum
of its hashed-word vectors; a bidirectional LSTM over the whole page then labels every line, so
that a title inside a list of other pages and the same kind of title inside the article can be
told apart by what stands around them. The labeller reads a page at a time and nothing else, so
pages are labelled where they lie, without a shuffle. Lines are read by arrays: a handful of
numpy calls a batch, never a loop over lines, words or characters.

It is trained in the run on a bounded sample of the table, labelled by how lines recur over
pages and hosts (`frames`); no wording is given. A part of the training pages is garbled by
wrong decoding, in whole or line by line, with the labels kept, so that garbled frames are
known as well.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, mojibake
from . import kernels as K
from .common import hashed_sample, out_batch, slices
from .lstm import Batch, Labeller

#: Pages that the labeller is trained on: half of them drawn by a hash of the id, half by hashes of host and id.
SAMPLE_PAGES, EPOCHS = 2400, 5

WORDS, WIDTH, HIDDEN = 1 << 14, 24, 32

#: Pages that run through the labeller side by side.
SIDE_BY_SIDE = 256

_SPACE, _LETTER, _DIGIT, _LOW, _UPPER, _HAN, _SINGLE = (1 << i for i in range(7))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(flags, lower case) of each code point of the basic plane; the last entry stands for all beyond it."""
    flags, lower = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32)
    for cp in range(0x10000):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        f = _SPACE if ch.isspace() else 0
        if kind[0] in "LM":
            f |= _LETTER
        elif kind[0] == "N":
            f |= _DIGIT
        if kind in ("Lu", "Lt"):
            f |= _UPPER
            lower[cp] = ord(ch.lower()[0])
        if 0x4E00 <= cp <= 0x9FFF:
            f |= _HAN
        if 0x3040 <= cp <= 0x30FF or 0x3400 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF:
            f = f & ~_LETTER | _SINGLE  # each a word of its own
        flags[cp] = f
    flags[0xFFFF] = _SINGLE
    return flags, lower


@dataclass
class Lines:
    """The non-blank lines of a batch of texts: where they stand, their shapes without the place, and their hashed words."""

    page: np.ndarray
    number: np.ndarray  # of the line in its text, counted from 0, blank lines too
    shapes: np.ndarray
    ids: np.ndarray
    starts: np.ndarray  # first id of each line


#: Shape features of a line by itself, and of its place.
_OWN, _PLACE = 20, 6
SHAPE = _OWN + _PLACE


def read_lines(texts: pa.Array) -> Lines:
    """Lines are split at \\n only; null texts have none."""
    cps, off = K.code_points(texts)
    flags_of, lower_of = _tables()
    narrow = np.minimum(cps, 0xFFFF)
    flag, low = flags_of[narrow], np.where(cps < 0xFFFF, lower_of[narrow], cps)
    n = len(cps)
    n_rows = len(off) - 1
    # lines of all texts, the line end left out
    ends = np.flatnonzero(cps == 10)
    begin = np.concatenate((off[:-1], ends + 1))
    stop = np.concatenate((ends, off[1:]))
    begin.sort()
    stop.sort()
    page = np.repeat(np.arange(n_rows), np.diff(np.searchsorted(ends, off)) + 1)
    first_of_page = np.concatenate(([0], np.cumsum(np.bincount(page, minlength=n_rows))))[:-1]
    number = np.arange(len(page)) - first_of_page[page]
    # without white space at both ends
    dark = np.flatnonzero((flag & _SPACE) == 0)
    a, b = np.searchsorted(dark, begin), np.searchsorted(dark, stop)
    some = b > a
    page, number, begin, a, b = page[some], number[some], begin[some], a[some], b[some]
    lo, hi = dark[a] if len(a) else a, (dark[b - 1] + 1 if len(b) else b)
    m = len(lo)
    if not m:
        return Lines(page, number, np.zeros((0, _OWN), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    line = np.zeros(n + 1, np.int32)
    line[lo] += 1
    line = np.cumsum(line[:-1]) - 1
    inside = np.zeros(n + 1, np.int8)
    inside[lo] += 1
    inside[hi] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
        return sums[hi] - sums[lo]

    def count(chars: str) -> np.ndarray:
        return total(np.isin(cps, np.array([ord(c) for c in chars], np.uint32)))

    def one_of(at: np.ndarray, chars: str) -> np.ndarray:
        return np.isin(cps[at], np.array([ord(c) for c in chars], np.uint32))

    length = hi - lo
    space = (flag & _SPACE) > 0
    before_space = np.concatenate(([True], space[:-1]))
    before_space[lo] = True
    word_start = inside & ~space & before_space
    upper = (flag & _UPPER) > 0
    words = total(word_start)
    last = cps[hi - 1]
    dots = (hi - lo >= 3) & (last == 46) & (cps[hi - 2] == 46) & (cps[np.maximum(hi - 3, 0)] == 46)
    own = np.stack(
        [
            np.log1p(length) / 6,
            np.log1p(words) / 4,
            total((flag & _DIGIT) > 0) / length,
            total(upper) / length,
            total(cps > 127) / length,
            total((flag & _HAN) > 0) / length,
            one_of(lo, "-*•#"),
            (flag[lo] & _DIGIT) > 0,
            upper[lo],
            one_of(hi - 1, ".!?。！？"),
            one_of(hi - 1, ":：,，;；"),
            dots | one_of(hi - 1, "…]"),
            np.minimum(count("|｜") / 3, 2),
            np.minimum(count("·•>»›«") / 3, 2),
            np.minimum(count("/") / 3, 2),
            count("©") > 0,
            np.minimum(count("_") / 3, 2),
            np.minimum(count("{}[]()=<>") / 4, 2),
            (words > 1) & (total(word_start & upper) == words),
            lo > begin,
        ],
        axis=1,
    ).astype(np.float32)

    # words: runs of letters, runs of digits (all alike), single characters; a run that holds an underscore is an identifier, all alike
    glue = (cps == 95) | ((flag & (_LETTER | _DIGIT)) > 0)
    kind = np.where(space | ~inside, 0, np.where((flag & _LETTER) > 0, 1, np.where((flag & _DIGIT) > 0, 2, 3)))
    fresh = np.concatenate(([True], line[1:] != line[:-1])) if n else np.zeros(0, bool)
    run = glue & inside
    run_start = run & (np.concatenate(([True], ~run[:-1])) | fresh)
    run_no = np.cumsum(run_start) - 1
    ident = np.zeros(max(int(run_start.sum()), 1), bool)
    ident[run_no[run & (cps == 95)]] = True
    named = run & ident[np.maximum(run_no, 0)]
    starts = (kind > 0) & ~named & ((kind == 3) | fresh | (np.concatenate(([0], kind[:-1])) != kind) | np.concatenate(([False], named[:-1])))
    starts |= run_start & named
    at = np.flatnonzero(starts)
    nth = np.arange(n) - at[np.maximum(np.cumsum(starts) - 1, 0)] if len(at) else np.zeros(n, np.int64)
    code = np.where(named, 1, np.where(kind == 2, 2, low)).astype(np.uint64)
    code = np.where((named | (kind == 2)) & (nth > 0), 0, K.mix((code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ K.mix(nth.astype(np.uint64) + np.uint64(0x51ED2701))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where((kind > 0) | named, code, np.uint64(0)), dtype=np.uint64)))
    # a word ends where the next one starts or its line does; white space between adds nothing
    stop = np.concatenate((at[1:], [n])) if len(at) else at
    word = K.mix(sums[stop] - sums[at])
    of = line[at]
    w = np.bincount(of, minlength=m)
    base = np.concatenate(([0], np.cumsum(2 * w + 1)))  # words, pairs of neighbours, first and last word
    first = np.concatenate(([0], np.cumsum(w)))
    ids = np.zeros(base[-1], np.uint64)
    i = np.arange(len(word)) - first[of]
    ids[base[of] + i] = word
    near = np.flatnonzero(of[1:] == of[:-1])
    ids[base[of[near]] + w[of[near]] + i[near]] = K.mix(word[near] * np.uint64(3) + word[near + 1])
    has = np.flatnonzero(w)
    ids[base[has] + 2 * w[has] - 1] = K.mix(word[first[has]] ^ np.uint64(0xA5A5A5A5))
    ids[base[has] + 2 * w[has]] = K.mix(word[first[has] + w[has] - 1] ^ np.uint64(0x5A5A5A5A5A))
    return Lines(page, number, own, (ids & np.uint64(WORDS - 1)).astype(np.int64), base[:-1])


def make_batch(lines: Lines, pages: np.ndarray) -> tuple[Batch, np.ndarray]:
    """Padded sequences of the given pages' lines, and the numbers of the lines in `lines`, page by page."""
    lo, hi = np.searchsorted(lines.page, pages), np.searchsorted(lines.page, pages, "right")
    n = hi - lo
    row, at = np.repeat(np.arange(len(pages)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    source = np.repeat(lo, n) + at
    size = np.repeat(n, n)
    shapes = np.zeros((len(pages), int(n.max(initial=1)), SHAPE), np.float32)
    shapes[row, at, :_OWN] = lines.shapes[source]
    shapes[row, at, _OWN:] = np.stack([at / np.maximum(size - 1, 1), 1 / (1 + at), 1 / (size - at), at < 3, size - at <= 3, np.minimum(size / 40, 2)], axis=1)
    ends = np.append(lines.starts[1:], len(lines.ids))
    k = (ends - lines.starts)[source] if len(source) else source
    starts = np.cumsum(k) - k
    ids = lines.ids[np.repeat(lines.starts[source] - starts, k) + np.arange(k.sum())] if len(source) else lines.ids[:0]
    return Batch(shapes, ids, starts, n), source


def frame_lines(texts: pa.Array, model: Labeller) -> tuple[Lines, np.ndarray]:
    """The lines of the texts, and which of them are frame."""
    lines = read_lines(texts)
    out = np.zeros(len(lines.page), bool)
    pages, n = np.unique(lines.page, return_counts=True)
    pages = pages[np.argsort(n, kind="stable")]
    for lo in range(0, len(pages), SIDE_BY_SIDE):
        batch, source = make_batch(lines, pages[lo : lo + SIDE_BY_SIDE])
        out[source] = model.logits(batch)[batch.mask] > 0
    return lines, out


def _batches(pages: list[list[str]], labels: list[list[int]], size: int = 64) -> list[tuple[Batch, np.ndarray, np.ndarray]]:
    """Training batches; lines of unsure label weigh nothing."""
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    out = []
    for lo in range(0, len(order), size):
        part = order[lo : lo + size]
        b, _ = make_batch(read_lines(pa.array(["\n".join(pages[k]) for k in part])), np.arange(len(part)))
        y = np.zeros(b.shapes.shape[:2], np.float32)
        for r, k in enumerate(part):
            y[r, : len(labels[k])] = labels[k]
        out.append((b, np.maximum(y, 0), (y >= 0).astype(np.float32)))
    return out


def non_blank(text: str | None) -> list[str]:
    return [line for line in (text or "").split("\n") if line.strip()]


#: Chains that training pages are garbled by, and those that tell a garbled page.
_AUGMENT = [c for c in mojibake.CHAINS if c not in ("utf-8 as big5", "cp1252 as cp437", "cp1252 as mac-roman", "cp1252 as cp1251")]
_TELL = ("utf-8 as latin-1", "utf-8 as cp1252", "utf-8 as gb18030", "utf-8 as cp932", "utf-8 as cp437", "utf-8 as mac-roman", "utf-8 as cp1251")


def training_pages(texts: list[str], seed: int = 23) -> tuple[list[list[str]], list[list[int]]]:
    """Labelled pages: sound ones, and garbled copies of those that hold characters beyond ASCII."""
    rng = np.random.default_rng(seed)
    # of garbled pages only the labels are known that recur; they are left out
    texts = [t for t in texts if not mojibake._LOST.search(t) and not any(mojibake.invert(w, c) for w in mojibake.tokens_of(t) for c in _TELL)]
    pages = [non_blank(t) for t in texts]
    labels = frames.label_pages(pages)
    for lines, y, text in list(zip(pages, labels, texts, strict=True)):
        if not text.isascii() and rng.random() < 0.6:
            chain = _AUGMENT[rng.integers(len(_AUGMENT))]
            part = 1.0 if rng.random() < 0.6 else 0.3
            bad = [((mojibake.garble(line, chain) or line) if rng.random() < part else line) for line in lines]
            # a line must stay one line, and not become blank
            pages.append([b if b.strip() and "\n" not in b else a for a, b in zip(lines, bad, strict=True)])
            labels.append(y)
    return pages, labels


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, epochs: int = EPOCHS) -> Labeller:
    usable = pages.where(F.length("text") > 0)
    host = F.regexp_extract("url", r"^[^/]*//([^/?#]*)", 1) if "url" in pages.columns else F.lit(None).cast("string")
    half = sample_pages // 2
    drawn = [
        hashed_sample(usable.select("page_id", "text"), "page_id", half).toArrow(),
        hashed_sample(usable.select("page_id", host.alias("host"), "text"), "page_id", sample_pages - half, F.nullif("host", F.lit(""))).select("page_id", "text").toArrow(),
    ]
    texts = {k: t for part in drawn for k, t in zip(part.column("page_id").to_pylist(), part.column("text").to_pylist(), strict=True)}
    model = Labeller(WORDS, WIDTH, SHAPE, HIDDEN)
    model.fit(_batches(*training_pages(list(texts.values()))), epochs)
    return model


def label(pages: DataFrame, model: Labeller | None = None, keep: tuple[str, ...] = (), bodies: bool = True) -> DataFrame:
    """page_id, `keep`, frame_lines (line numbers of the page frame), body (the other lines, if wanted). Null and empty texts have no frame and an empty body."""
    held = pages.sparkSession.sparkContext.broadcast(model or fit(pages))
    fields = pages.select("page_id", *keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", frame_lines array<bigint>" + (", body string" if bodies else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 400_000):
            texts = batch.column("text")
            lines, is_frame = frame_lines(texts, held.value)
            page, number = lines.page[is_frame], lines.number[is_frame]
            cuts = np.searchsorted(page, np.arange(batch.num_rows + 1))
            cols = {c: batch.column(c) for c in ("page_id", *keep)}
            cols["frame_lines"] = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(number.astype(np.int64)))
            if bodies:
                kept = []
                for i, text in enumerate(texts.to_pylist()):
                    out = set(number[cuts[i] : cuts[i + 1]].tolist())
                    kept.append("\n".join(line for k, line in enumerate((text or "").split("\n")) if k not in out))
                cols["body"] = pa.array(kept, pa.string())
            yield out_batch(cols)

    return pages.select("page_id", *keep, "text").mapInArrow(run, schema)


def found(pages: DataFrame) -> DataFrame:
    """(page_id, line_no) of every non-blank line outside the page's main body."""
    return label(pages, bodies=False).select("page_id", F.explode("frame_lines").alias("line_no"))
