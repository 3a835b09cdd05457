"""Whole plans put together from operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import chunk_id, clean_text, document_gate
from lorewell.operators.chunking import chunk_documents, semantic_chunks
from lorewell.operators.embed import Embedder
from lorewell.operators.merge import upsert
from lorewell.sources.files import Detector, FileExtractor, read_files
from lorewell.sources.knowledge_base import KnowledgeBases

from .session import cut


def ingest_chunks(files: DataFrame) -> DataFrame:
    """Files (file_no, source, ext, text) to merged chunks (id, file_no, ordinal, chunk, source, method), in one lazy plan.

    Clean, gate, split, identify; equal ids keep their first place and take the last values.
    """
    name = F.coalesce("source", F.lit(""))
    ready = files.select("file_no", name.alias("source"), "ext", clean_text(F.col("text")).alias("text")).where(document_gate(F.col("text")))
    pieces = ready.select("file_no", "source", F.posexplode(semantic_chunks(F.col("text"), F.col("ext"))).alias("ordinal", "chunk"))
    rows = pieces.select(chunk_id(F.col("source"), F.col("chunk")).alias("id"), F.struct("file_no", "ordinal").alias("place"), "chunk", "source", F.lit("semantic_chunk").alias("method"))
    return upsert(rows, "id", "place").select("id", "place.file_no", F.col("place.ordinal").cast("bigint").alias("ordinal"), "chunk", "source", "method")


@dataclass(frozen=True)
class IngestReport:
    """What an upload did: entries of the knowledge base afterwards, entries of the upload (repeats among them), and the files that failed."""

    kb: str
    total: int
    new: int
    errors: DataFrame  # source, error
    n_errors: int

    @property
    def message(self) -> str:
        # Fixed value: the wording of a successful upload.
        done = f"成功！知识库 '{self.kb}' 更新完毕。\n总条目: {self.total}\n本次新增: {self.new}"
        return done if not self.n_errors else f"{done}\n错误: {self.n_errors}"


def ingest_files(bases: KnowledgeBases, kb: str, path: str, embedder: Embedder, extractor: FileExtractor | None = None, detector: Detector | None = None) -> IngestReport:
    """Reads the files of a folder, splits and merges them into a knowledge base, which is created if there is none, and embeds what has no vector.

    A file that cannot be read, or is too short, is reported and the others go on. ValueError for a blank name.
    """
    if not bases.exists(kb):
        bases.create(kb)
    files = cut(read_files(bases.spark, path, extractor, detector=detector))
    short = ~document_gate(clean_text(F.col("text")))
    errors = files.select("source", F.coalesce("error", F.when(short, F.lit("too short"))).alias("error")).where("error IS NOT NULL")
    chunks = cut(chunk_documents(files.where("error IS NULL")).withColumn("pos", F.monotonically_increasing_id()))
    total, new = bases.merge(kb, chunks)
    bases.embed(kb, embedder)
    return IngestReport(kb, total, new, errors, errors.count())
