"""Keyed Parquet tables in buckets, changed over by a manifest; and small files through Spark's file systems."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators.merge import upsert


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p) and not fs.delete(p, True):
        raise OSError(f"cannot delete {path}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its old version and change over by renaming."""
    fs, old = _fs(spark, path)
    _, new = _fs(spark, path + ".new")
    out = fs.create(new, True)
    out.write(text.encode())
    out.close()
    fs.delete(old, False)
    if not fs.rename(new, old):
        raise OSError(f"cannot rename to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None; its new version, if a writer ended between deleting the old one and renaming."""
    for at in (path, path + ".new"):
        fs, p = _fs(spark, at)
        if fs.exists(p):
            stream = fs.open(p)
            try:
                return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
    return None


class BucketStore:
    """Rows by a unique key, in folders of hash buckets. An upsert rewrites only the buckets that its keys fall into.

    The manifest names the folder, the number of rows and the end of the positions of each bucket.
    New folders are written first, then the manifest is changed over, then old folders are deleted,
    so that a failure at any point leaves either the old table or the new one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", pos: str = "pos", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.pos, self.buckets = spark, path.rstrip("/"), schema, key, pos, buckets

    def _state(self) -> dict:
        text = read_text(self.spark, f"{self.path}/_manifest.json")
        return json.loads(text) if text else {"buckets": self.buckets, "end": 0, "folders": {}, "rows": {}}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in sorted(folders)))

    def read(self) -> DataFrame:
        return self._read(list(self._state()["folders"].values()))

    def count(self) -> int:
        return sum(self._state()["rows"].values())

    def drop(self) -> None:
        remove(self.spark, self.path)

    def merge(self, new: DataFrame, keep: DataFrame | None = None) -> tuple[int, int]:
        """Upserts rows whose `pos` counts within the batch: first position, last values. Returns (rows of the table, rows of the batch).

        keep: what is kept of the old rows, if not all of them; every bucket is rewritten then. Rows with a null key are left out.
        """
        state = self._state()
        columns = self.spark.createDataFrame([], self.schema).columns
        # positions of a batch follow all earlier ones
        batch = new.where(F.col(self.key).isNotNull()).select(*((F.col(c) + state["end"]).alias(c) if c == self.pos else c for c in columns))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(state["buckets"]))
        # one row a bucket
        sizes = {r["b"]: (r["n"], r["end"]) for r in batch.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.max(self.pos).alias("end")).collect()}
        touched = {str(b) for b in sizes} | (set(state["folders"]) if keep is not None else set())
        if not touched:
            return sum(state["rows"].values()), 0
        old = keep.select(*columns) if keep is not None else self._read([f for b, f in state["folders"].items() if b in touched])
        merged = upsert(old.unionByName(batch), self.key, self.pos).select(*columns)
        folder = f"part-{uuid.uuid4().hex}"
        merged.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        made = {str(b): n for b, n in self.spark.read.parquet(f"{self.path}/{folder}").groupBy("bucket").count().collect()}
        gone = [f for b, f in state["folders"].items() if b in touched]
        for b in touched:
            state["folders"].pop(b, None)
            state["rows"].pop(b, None)
        state["folders"] |= {b: f"{folder}/bucket={b}" for b in made}
        state["rows"] |= made
        state["end"] = max([state["end"], *(end + 1 for _, end in sizes.values())])
        write_text(self.spark, f"{self.path}/_manifest.json", json.dumps(state))
        for f in gone:
            remove(self.spark, f"{self.path}/{f}")
        return sum(state["rows"].values()), sum(n for n, _ in sizes.values())
