"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: control characters that cleaning deletes (tab, line feed and carriage return stay, to be collapsed as white space).
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
# White space of Unicode; the plain \s of Java knows ASCII only.
SPACE = r"(?U)\s+"

REASONING = T.StructType(
    [
        T.StructField("analysis", T.StringType()),
        T.StructField("missing_info", T.ArrayType(T.StringType())),
        T.StructField("follow_up_queries", T.ArrayType(T.StringType())),
        T.StructField("is_sufficient", T.BooleanType()),
    ]
)


def clean_text(c: Column) -> Column:
    """Control characters deleted, runs of white space as one space, trimmed; null gives an empty string."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), CONTROL, ""), SPACE, " "))


def document_gate(c: Column, longer_than: int = 10) -> Column:
    """Whether a cleaned text is long enough to be a document."""
    return F.length(c) > longer_than


def file_extension(name: Column) -> Column:
    """Lower-cased extension with its dot; empty for names without one and for dot files."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))


def embed_input(c: Column, cap: int = 8000) -> Column:
    """The text cut to what an embedder takes; null for empty and null texts, which are skipped."""
    cut = F.substring(c, 1, cap)
    return F.when(F.length(cut) > 0, cut)


def not_blank(c: Column) -> Column:
    """False for null, empty and white-space-only texts."""
    return F.coalesce(F.length(F.regexp_replace(c, SPACE, "")) > 0, F.lit(False))


def web_background(c: Column, cap: int = 1500) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")), 1, cap)


def sentence(c: Column) -> Column:
    """White-space runs (with the separators U+001C to U+001F) as one space, not trimmed."""
    return F.regexp_replace(c, r"(?U)[\s\x1C-\x1F]+", " ")


def kb_name(c: Column) -> Column:
    """Trimmed, with everything but letters, digits and underscores replaced by an underscore."""
    return F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}_]", "_")


def preview(c: Column, n: int = 100) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def chunk_id(source: Column, chunk: Column) -> Column:
    """md5 of source, underscore and chunk."""
    return F.md5(F.concat(source, F.lit("_"), chunk))


def yes_no(c: Column) -> Column:
    return F.when(c, F.lit("是")).otherwise(F.lit("否"))


def keyword_weight(weight: Column, scale: Column) -> Column:
    return F.round(weight * scale, 4)


def result_title(c: Column) -> Column:
    """The part of a result's title before the first hyphen, trimmed."""
    return F.trim(F.substring_index(c, "-", 1))


def parse_reasoning(c: Column) -> Column:
    """A reasoning step from JSON. Missing keys become empty, not sufficient; what is no JSON object gives a fixed fallback."""
    raw = F.from_json(c, REASONING, {"mode": "PERMISSIVE"})
    empty = F.array().cast("array<string>")
    is_object = F.coalesce(F.trim(c).startswith("{") & F.get_json_object(c, "$").isNotNull(), F.lit(False))
    parsed = F.struct(
        F.coalesce(raw["analysis"], F.lit("")).alias("analysis"),
        F.coalesce(raw["missing_info"], empty).alias("missing_info"),
        F.coalesce(raw["follow_up_queries"], empty).alias("follow_up_queries"),
        F.coalesce(raw["is_sufficient"], F.lit(False)).alias("is_sufficient"),
    )
    # The step that stands for one that cannot be read.
    fallback = F.struct(
        F.lit("无法分析检索到的信息。").alias("analysis"),
        F.array(F.lit("无法识别缺失信息")).alias("missing_info"),
        empty.alias("follow_up_queries"),
        F.lit(False).alias("is_sufficient"),
    )
    return F.when(is_object, parsed).otherwise(fallback)
