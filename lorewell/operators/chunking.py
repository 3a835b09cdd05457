"""Splitting texts into chunks and sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import chunk_id, clean_text, document_gate

# The separators of each kind of file, strongest first. Cleaned texts hold no line
# breaks, so those entries can only match in texts that were not cleaned.
PROFILES: dict[str, list[str]] = {
    "prose": ["\n\n", "。", "！", "？", "；", "，", "\n", " ", ""],
    "plain": ["<|endoftext|>", "\n\n", "\n", ";", ""],
    "code": ["endmodule", "\n\n", "\n", ";", ""],
}
# The same of the older chunker.
OLDER_PROFILES: dict[str, list[str]] = {
    "prose": ["\n\n", "。", "，", "！", "？", "；", "\n", " ", ""],
    "plain": ["<|endoftext|>", "\n\n", "\n", " ", ""],
    "code": ["endmodule", "\n\n", "\n", " ", ""],
}
EXTENSIONS = {".pdf": "prose", ".txt": "plain", ".v": "code", ".sv": "code"}


def profile_of(ext: str | None) -> str:
    return EXTENSIONS.get((ext or "").lower(), "prose")


def _pieces(text: str, sep: str) -> list[str]:
    """The text cut before each separator, so that a separator begins the piece after it."""
    if not sep:
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in [head, *(sep + r for r in rest)] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Joins of neighbouring pieces up to `size`; each carries back trailing pieces of the one before, up to `overlap` in all."""
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            yield "".join(held)
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if held:
        yield "".join(held)


def split_recursive(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    """Chunks of at most `size` characters, cut at the first separator that occurs; longer pieces go on with the weaker ones."""
    level = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    weaker = separators[level + 1 :]
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            short.append(piece)
            continue
        out.extend(_pack(short, size, overlap))
        short = []
        out.extend(split_recursive(piece, weaker, size, overlap) if weaker else [piece])
    out.extend(_pack(short, size, overlap))
    return [c for c in (c.strip() for c in out) if c]


def windows(text: str, size: int, overlap: int) -> list[str]:
    """What the recursion gives where only single characters can be packed, by arithmetic instead of a loop over characters."""
    step = size - overlap
    n = max(1, -(-(len(text) - overlap) // step))
    return [c for c in (text[i * step : i * step + size].strip() for i in range(n)) if c]


def split_text(text: str | None, ext: str | None, size: int = 2000, overlap: int = 20, least: int = 20, profiles: dict[str, list[str]] = PROFILES) -> list[str]:
    if not text:
        return []
    separators = profiles[profile_of(ext)]
    if any(s and s in text for s in separators):
        chunks = split_recursive(text, separators, size, overlap)
    else:
        chunks = windows(text, size, overlap)
    return [c for c in chunks if len(c) >= least]


def semantic_chunks(text: Column, ext: Column, size: int = 2000, overlap: int = 20, least: int = 20, profiles: dict[str, list[str]] = PROFILES) -> Column:
    """array<string> of the chunks of a text by the profile of its extension. Null and empty texts give an empty array."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, exts: pd.Series) -> pd.Series:
        return pd.Series([split_text(t, e, size, overlap, least, profiles) for t, e in zip(texts, exts, strict=True)], dtype=object)

    return run(text, ext)


def char_windows(text: Column, size: int = 2000, overlap: int = 20) -> Column:
    """array<string>: windows of `size` characters, each starting `size - overlap` after the one before. No Python."""
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.trim(F.substr(text, i * step + 1, F.lit(size))))


def chunk_documents(docs: DataFrame, text: str = "text", source: str = "source", ext: str = "ext", size: int = 2000, overlap: int = 20, least: int = 20) -> DataFrame:
    """Cleaned, gated, split and identified: source, ordinal, id, chunk, metadata, method. Null sources count as an empty name."""
    name = F.coalesce(F.col(source), F.lit(""))
    ready = docs.select(name.alias("source"), F.col(ext).alias("ext"), clean_text(F.col(text)).alias("text")).where(document_gate(F.col("text")))
    pieces = ready.select("source", F.posexplode(semantic_chunks(F.col("text"), F.col("ext"), size, overlap, least)).alias("ordinal", "chunk"))
    return pieces.select(
        "source", F.col("ordinal").cast("bigint").alias("ordinal"), chunk_id(F.col("source"), F.col("chunk")).alias("id"), "chunk", F.struct("source").alias("metadata"), F.lit("semantic_chunk").alias("method")
    )


def chunk_documents_numbered(docs: DataFrame, size: int = 800, overlap: int = 20, least: int = 20, cap: int = 8000) -> DataFrame:
    """The older layout, with its own separators: ids `chunk<i>` counted before short chunks are dropped, and hashes of texts cut to `cap`."""
    ready = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.col("ext"), clean_text(F.col("text")).alias("text")).where(document_gate(F.col("text")))
    pieces = ready.select("source", F.posexplode(semantic_chunks(F.col("text"), F.col("ext"), size, overlap, 0, OLDER_PROFILES)).alias("ordinal", "chunk"))
    return pieces.where(F.length("chunk") >= least).select(
        "source",
        F.concat(F.lit("chunk"), F.col("ordinal")).alias("number"),
        chunk_id(F.col("source"), F.substring(clean_text(F.col("chunk")), 1, cap)).alias("id"),
        "chunk",
        F.lit("semantic_chunk").alias("method"),
    )


def _cut_at(text: str, longest: int, mark: str) -> list[str]:
    """Neighbouring sentences, each with its mark, joined while the last one ends within longest - 1 characters of the first's begin."""
    marks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == ord(mark))
    begins, ends = np.append(0, marks + 1), np.append(marks, len(text))
    # a sentence without a character never begins a new join
    full = np.flatnonzero(ends > begins)
    cuts, at = [0], 0
    while True:
        too_far = max(int(np.searchsorted(ends, begins[at] + longest - 1, "right")), at + 1)
        nth = int(np.searchsorted(full, too_far))
        if nth == len(full):
            break
        at = int(full[nth])
        cuts.append(int(begins[at]))
    return [text[lo:hi].strip() for lo, hi in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def segments(text: str, longest: int, separators: str = "\n。") -> list[str]:
    """Sentences packed up to `longest` - 1 characters at the first separator; what is still too long goes on with the next. Separators stay at the end."""
    done = [text.strip()]
    for mark in separators:
        done = [piece for part in done for piece in (_cut_at(part, longest, mark) if len(part) > longest else [part])]
    return done


def segment_column(text: Column, longest: int = 400, separators: str = "\n。") -> Column:
    """array<string> of the segments; null gives an empty array."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([segments(t, longest, separators) if t is not None else [] for t in texts], dtype=object)

    return run(text)


def batch_plan(df: DataFrame, size: int) -> DataFrame:
    """batch_no (from 0) and n_rows of the contiguous batches that a row count makes; no batch for an empty table."""
    n = df.agg(F.count("*").alias("n")).where("n > 0")
    no = n.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / size))).alias("batch_no"))
    return no.select("batch_no", F.least(F.lit(size), F.col("n") - F.col("batch_no") * size).cast("bigint").alias("n_rows"))
