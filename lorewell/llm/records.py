"""Canonical keys of chunks: letters and digits in order, or the field set of a register record."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import out_batch, slices

#: A chunk with fewer letters and digits than this is left out of every duplicate search.
MIN_LETTERS = 20

# Field separators, name/value separators and field names of the flat record notation, ASCII or full width.
_PARTS = regex.compile(r"[;；|｜\r\n]+")
_FIELD = regex.compile(r"""\s*["'“”]?([\p{L}_][\p{L}\p{N}_\-]*(?: [\p{L}_\-]+)?)["'“”]?\s*[:：=＝](.*)""", regex.S)
# What every record begins with, for a scan of whole columns: a brace, or a name before a separator.
_BEGINS = r"^\s*[{｛]|^[^\p{L}_]*[\p{L}_][\p{L}\p{N}_\-]*(?: [\p{L}_\-]+)?[^\p{L}\p{N}]*[:：=＝]"
_DROP = regex.compile(r"[^\p{L}\p{N}]+")


def letters(text: str) -> str:
    """Unicode letters and numbers of a text, lower-cased."""
    return _DROP.sub("", text).lower()


def record_fields(text: str) -> list[tuple[str, str]] | None:
    """The (name, value) pairs of a register record, folded to letters and digits; None for any other text.

    A record is a JSON object, or at least two parts between `;`, `|` or line ends that are all
    `name: value` or `name = value`, where a name is one word or two words without digits.
    """
    body = text.strip()
    if body[:1] == "{" and body[-1:] == "}":
        try:
            obj = json.loads(body)
        except ValueError:
            obj = None
        if isinstance(obj, dict) and obj:
            return [(letters(k), letters(v if isinstance(v, str) else json.dumps(v))) for k, v in obj.items()]
    if not _FIELD.match(body.lstrip("{｛")):
        return None
    out = []
    for part in _PARTS.split(body.strip("{}｛｝")):
        m = _FIELD.match(part)
        if m:
            out.append((letters(m[1]), letters(m[2])))
        elif _DROP.sub("", part):
            return None
    return out if len(out) > 1 else None


def record_key(fields: list[tuple[str, str]]) -> bytes:
    body = "\x1e".join(sorted({f"{n}\x1f{v}" for n, v in fields}))
    return hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def chunk_keys(texts: pa.Array, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k1, k2, t): the 128-bit copy key of each text, and the 64-bit key of its letters alone."""
    t = K.text_keys(codes, off)
    k1, k2 = t.copy(), K.mix(t ^ K.text_keys(codes[::-1], off[-1] - off[::-1])[::-1])
    maybe = np.flatnonzero(pa.compute.fill_null(pa.compute.match_substring_regex(texts, _BEGINS), False).to_numpy(zero_copy_only=False))
    for i, text in zip(maybe, texts.take(pa.array(maybe)).to_pylist(), strict=True):
        if fields := record_fields(text):
            k1[i], k2[i] = np.frombuffer(record_key(fields), np.uint64)
    return k1, k2, t


def keyed(df: DataFrame, keep: list[str], text: str = "chunk") -> DataFrame:
    """Rows with at least MIN_LETTERS letters and digits: the columns `keep`, n_letters, k1, k2 and t.

    Null and short texts give no row.
    """
    fields = df.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_letters bigint, k1 bigint, k2 bigint, t bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = batch.column("_text")
            codes, off = K.fold(texts)
            n = np.diff(off)
            k1, k2, t = chunk_keys(texts, codes, off)
            cols = {c: batch.column(c) for c in keep}
            cols |= {"n_letters": n, "k1": K.signed(k1), "k2": K.signed(k2), "t": K.signed(t)}
            yield out_batch(cols).filter(pa.array(n >= MIN_LETTERS))

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
