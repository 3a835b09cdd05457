"""Knowledge bases: chunk ledgers and their vectors in bucketed Parquet; list, create, drop, files, merge, embed, search."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.config import Settings
from lorewell.operators.embed import Embedder, embed_column, embed_missing
from lorewell.operators.search import search

from . import store
from .store import BucketStore

CHUNK_SCHEMA = "pos bigint, id string, chunk string, metadata struct<source:string>, source string, method string"
VECTOR_SCHEMA = "pos bigint, id string, vector array<float>"


def safe_name(name: str) -> str:
    """The trimmed name with everything but letters, digits and underscores replaced; ValueError if nothing is left."""
    out = "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else "_" for c in name.strip())
    if not out:
        raise ValueError("a knowledge base needs a name")
    return out


class KnowledgeBases:
    """Chunk and vector tables under a root folder, one folder `kb=<name>` of each."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings

    def path(self, kb: str, table: str = "chunks") -> str:
        return f"{self.root}/{table}/kb={safe_name(kb)}"

    def exists(self, kb: str, table: str = "chunks") -> bool:
        return store.exists(self.spark, self.path(kb, table))

    def list(self) -> list[str]:
        """Sorted names; the default one is always among them."""
        fs, p = store._fs(self.spark, f"{self.root}/chunks")
        names = [s.getPath().getName()[3:] for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted({*names, self.settings.default_kb})

    def create(self, kb: str) -> str:
        """Creates an empty knowledge base and returns its safe name; FileExistsError if there is one."""
        name = safe_name(kb)
        if self.exists(name):
            raise FileExistsError(name)
        fs, p = store._fs(self.spark, self.path(name))
        fs.mkdirs(p)
        return name

    def drop(self, kb: str) -> None:
        """Removes a knowledge base. The default one cannot be removed; only safe names are accepted."""
        if kb != safe_name(kb) or not re.fullmatch(r"\w+", kb):
            raise ValueError(f"not a name of a knowledge base: {kb!r}")
        if kb == self.settings.default_kb:
            raise PermissionError("the default knowledge base stays")
        if not self.exists(kb):
            raise FileNotFoundError(kb)
        for table in ("chunks", "vectors"):
            store.remove(self.spark, self.path(kb, table))

    def _store(self, kb: str, table: str = "chunks") -> BucketStore:
        return BucketStore(self.spark, self.path(kb, table), CHUNK_SCHEMA if table == "chunks" else VECTOR_SCHEMA)

    def chunks(self, kb: str) -> DataFrame:
        """The chunk ledger; empty for a new knowledge base. A damaged ledger is an error, not an empty one."""
        return self._store(kb).read()

    def vectors(self, kb: str) -> DataFrame:
        return self._store(kb, "vectors").read()

    def files(self, kb: str) -> DataFrame:
        return self.chunks(kb).select("source").where("source IS NOT NULL").distinct().orderBy("source")

    def merge(self, kb: str, new: DataFrame, replace_sources: bool = False) -> tuple[int, int]:
        """Upserts chunks (id, chunk, source, method, pos within the batch) by id: first position, last values.

        Returns the number of entries afterwards and that of the batch, repeats among them. With
        replace_sources, earlier chunks of the batch's files are dropped first.
        """
        rows = new.select("pos", "id", "chunk", F.struct("source").alias("metadata"), "source", "method")
        keep = self.chunks(kb).join(new.select("source").distinct(), "source", "left_anti") if replace_sources else None
        return self._store(kb).merge(rows, keep)

    def embed(self, kb: str, embedder: Embedder) -> int:
        """Gives a vector to every chunk that has none yet, and drops those whose chunk is gone or changed its place. Returns the number of vectors."""
        chunks, stored = self.chunks(kb), self._store(kb, "vectors")
        have = stored.read()
        current = have.join(chunks.select("id", "pos"), ["id", "pos"], "left_semi")
        stale = not have.join(chunks.select("id", "pos"), ["id", "pos"], "left_anti").isEmpty()
        made = embed_missing(chunks.select("id", "pos", "chunk"), current, embedder).where("vector IS NOT NULL").select("pos", "id", "vector")
        # vectors keep the places of their chunks, which a merge would shift
        placed = made.withColumn("pos", F.col("pos") - stored._state()["end"])
        # only buckets of new vectors are rewritten, unless some have to go
        return stored.merge(placed, current if stale else None)[0]

    def search(self, kb: str, questions: DataFrame, embedder: Embedder, k: int = 5, metric: str = "ip") -> DataFrame:
        """(qid, rk, id, chunk, score) of each question's k best chunks. questions: qid, question; blank ones have no hits."""
        asked = embed_column(questions.select("qid", "question"), "question", embedder).where("vector IS NOT NULL AND trim(question) <> ''")
        hits = search(asked, self.vectors(kb), k, metric)
        # a hit is looked up by its place: k rows a question
        return hits.join(self.chunks(kb).select("pos", "id", "chunk"), "pos").select("qid", "rk", "id", "chunk", "score")
