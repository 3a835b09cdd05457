"""Reading uploaded files: bytes to text, with the encodings tried in order; PDF text by a plug-in."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.text import file_extension

# The encodings tried in order; the last never fails.
ENCODINGS = ("utf-8", "gbk", "gb18030", "latin-1")


# The encodings tried in order where detection is not sure, and how sure it must be.
DETECTED_ENCODINGS = ("utf-8", "gbk", "gb18030", "gb2312", "latin-1", "utf-16", "cp936", "big5")
LEAST_CONFIDENCE = 0.7


class Detector(Protocol):
    """Guesses an encoding: (name or None, confidence from 0 to 1)."""

    def detect(self, raw: bytes) -> tuple[str | None, float]: ...


class ByteDetector:
    """Offline detector: byte order marks, strict UTF-8, and the share of common characters under a Chinese code page."""

    MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))

    def detect(self, raw: bytes) -> tuple[str | None, float]:
        for mark, name in self.MARKS:
            if raw.startswith(mark):
                return name, 1.0
        try:
            text = raw.decode("utf-8")
            return ("ascii", 1.0) if text.isascii() else ("utf-8", 0.99)
        except UnicodeDecodeError:
            pass
        best: tuple[str | None, float] = (None, 0.0)
        for name in ("gb18030", "big5"):
            try:
                beyond = [c for c in raw.decode(name) if ord(c) > 127]
            except UnicodeDecodeError:
                continue
            # the first level of the national standard holds the common characters; its lead bytes end at 0xD7
            common = sum(0xB0 <= b[0] <= 0xD7 or b[0] == 0xA1 or b[0] == 0xA3 for c in beyond if len(b := c.encode("gb2312", "ignore")) == 2)
            share = common / max(len(beyond), 1)
            if share > best[1]:
                best = (name, share)
        return best


class FileExtractor(Protocol):
    """Text of a binary document, such as the pages of a PDF joined by blank lines. Raises if it cannot be read."""

    def extract(self, content: bytes) -> str: ...


def decode_bytes(raw: bytes | None, encodings: tuple[str, ...] = ENCODINGS) -> str | None:
    """The text under the first encoding that decodes it strictly; null stays null."""
    if raw is None:
        return None
    for e in encodings:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return lenient_utf8(raw)


def lenient_utf8(raw: bytes) -> str:
    """UTF-8 without the bytes that are none."""
    return raw.decode("utf-8", "ignore")


def decode_detected(raw: bytes | None, detector: Detector | None = None) -> str | None:
    """The text under the detected encoding if detection is sure, else under the first of DETECTED_ENCODINGS that fits; lenient UTF-8 where that fails. Null stays null."""
    if raw is None:
        return None
    name, confidence = (detector or ByteDetector()).detect(raw)
    if not name or confidence <= LEAST_CONFIDENCE:
        return decode_bytes(raw, DETECTED_ENCODINGS)
    try:
        return raw.decode(name)
    except (UnicodeDecodeError, LookupError):
        return lenient_utf8(raw)


def decode_column(content: Column, encodings: tuple[str, ...] = ENCODINGS) -> Column:
    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda b: decode_bytes(bytes(b) if b is not None else None, encodings))

    return run(content)


def detected_column(content: Column, detector: Detector | None = None) -> Column:
    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda b: decode_detected(bytes(b) if b is not None else None, detector))

    return run(content)


def read_files(spark: SparkSession, path: str, extractor: FileExtractor | None = None, encodings: tuple[str, ...] = ENCODINGS, detector: Detector | None = None) -> DataFrame:
    """(path, source, ext, text, error) of the files of a folder; a file that cannot be read has an error and no text. With a detector, encodings are detected."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    @F.pandas_udf("struct<text:string, error:string>")
    def run(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for e, b in zip(ext, content, strict=True):
            try:
                if e == ".pdf":
                    if extractor is None:
                        raise ValueError("no extractor for this kind of file")
                    rows.append((extractor.extract(bytes(b)), None))
                else:
                    rows.append((decode_detected(bytes(b), detector) if detector else decode_bytes(bytes(b), encodings), None))
            except Exception as x:  # recorded for the file; the others go on
                rows.append((None, f"{type(x).__name__}: {x}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    named = raw.select("path", name.alias("source"), file_extension(name).alias("ext"), "content")
    return named.select("path", "source", "ext", run("ext", "content").alias("r")).select("path", "source", "ext", "r.text", "r.error")
