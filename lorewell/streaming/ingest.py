"""Incremental ingest: files that arrive in a folder are decoded, cleaned, split and merged, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorewell.functions.text import file_extension
from lorewell.operators.chunking import chunk_documents
from lorewell.plans.session import cut
from lorewell.sources.files import decode_column
from lorewell.sources.knowledge_base import KnowledgeBases

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_ingest(spark: SparkSession, folder: str, bases: KnowledgeBases, kb: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that takes what is in the folder and ends; the checkpoint remembers the files done."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    docs = files.select(name.alias("source"), file_extension(name).alias("ext"), decode_column(F.col("content")).alias("text"))

    def merge(batch: DataFrame, _: int) -> None:
        chunks = chunk_documents(batch)
        # checkpointed, since the merge reads the places twice
        bases.merge(kb, cut(chunks.withColumn("pos", F.monotonically_increasing_id())))

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
