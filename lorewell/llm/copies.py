"""Problem 3: duplicates hidden by formatting differences, with an incremental ledger of copy counts.

The ledger holds one row a canonical key: (k1, k2, first_pos, n_copies), in folders of hash
buckets in the shared folder. A new batch is aggregated to its own keys first (map-side combine,
so a key that holds a third of the rows shuffles one row a task), then full-outer-joined with
the buckets that its keys fall into; only these are read and written again. Counts add up, and
the earliest representative (smallest pos) stays. A manifest names the folder of each bucket;
it is changed over after the new folders are written, and lets a later session go on.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path, read_text, remove, write_text
from .records import keyed

LEDGER_COLUMNS = ["k1", "k2", "first_pos", "n_copies"]
LEDGER = "k1 bigint, k2 bigint, first_pos bigint, n_copies bigint"

#: A key is hot if it holds more than 1/HOT_PARTS of all rows; so there are fewer than HOT_PARTS of them.
HOT_PARTS = 256

#: Keys of a bucket that the number of buckets is planned for.
BUCKET_KEYS = 2_000_000


class Ledger:
    """Bucketed canonical-key counts in the shared folder; `create` or `open` one, then `add` batches of keyed rows.

    Empty batches leave the ledger as it is. Before the first batch the ledger is empty.
    """

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path.rstrip("/"), state

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, keys: int = 0, buckets: int | None = None) -> Ledger:
        """An empty ledger, with buckets planned for so many keys in all."""
        ledger = cls(spark, path or new_path(spark, "copy-ledger"), {"buckets": buckets or max(16, math.ceil(keys / BUCKET_KEYS)), "folders": {}})
        ledger._save()
        return ledger

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Ledger:
        """The ledger that an earlier session left there."""
        text = read_text(spark, f"{path.rstrip('/')}/_manifest.json")
        if text is None:
            raise FileNotFoundError(path)
        return cls(spark, path, json.loads(text))

    def _save(self) -> None:
        write_text(self.spark, f"{self.path}/_manifest.json", json.dumps(self.state))

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*(f"{self.path}/{f}" for f in sorted(folders)))

    def frame(self) -> DataFrame:
        return self._read(list(self.state["folders"].values()))

    def add(self, batch: DataFrame) -> list[str]:
        """Folds in a batch (pos, k1, k2) and returns the buckets that were written again."""
        bucket = F.pmod(F.xxhash64("k1", "k2"), F.lit(self.state["buckets"])).cast("int")
        new = materialise(batch.groupBy("k1", "k2").agg(F.min("pos").alias("b_pos"), F.count("*").alias("b_n")).withColumn("bucket", bucket), "copy-batch")
        # one number a bucket
        touched = sorted(str(b) for (b,) in new.select("bucket").distinct().collect())
        if not touched:
            return []
        old = self._read([self.state["folders"][b] for b in touched if b in self.state["folders"]])
        out = old.join(new, ["k1", "k2"], "full_outer").select(
            "k1",
            "k2",
            F.least("first_pos", "b_pos").alias("first_pos"),
            (F.coalesce("n_copies", F.lit(0)) + F.coalesce("b_n", F.lit(0))).alias("n_copies"),
        )
        folder = f"part-{uuid.uuid4().hex}"
        # a task holds few buckets, so that a bucket is few files
        out.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        gone = [self.state["folders"][b] for b in touched if b in self.state["folders"]]
        self.state["folders"] |= {b: f"{folder}/bucket={b}" for b in touched}
        self._save()
        for f in gone:
            remove(self.spark, f"{self.path}/{f}")
        return touched

    def drop(self) -> None:
        remove(self.spark, self.path)


def with_first(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each keyed row with its key's first_pos and n_copies.

    Hot keys (fewer than HOT_PARTS by construction) go through a broadcast, so their rows are
    never sent to one task; all others hold at most 1/HOT_PARTS of the rows and are shuffled.
    """
    total = ledger.agg(F.coalesce(F.sum("n_copies"), F.lit(0))).first()[0]
    hot_at = max(total // HOT_PARTS, 1000)
    hot = F.broadcast(ledger.where(F.col("n_copies") > hot_at).withColumnRenamed("first_pos", "h_pos").withColumnRenamed("n_copies", "h_n"))
    marked = rows.join(hot, ["k1", "k2"], "left")
    cold = marked.where(F.col("h_pos").isNull()).drop("h_pos", "h_n").join(ledger.where(F.col("n_copies") <= hot_at), ["k1", "k2"])
    known = marked.where(F.col("h_pos").isNotNull()).withColumnRenamed("h_pos", "first_pos").withColumnRenamed("h_n", "n_copies")
    return cold.unionByName(known)


def count_copies(chunks: DataFrame, batch: str = "batch_no") -> tuple[DataFrame, Ledger]:
    """Keyed rows of a chunk table, and the ledger after adding its batches in order.

    Null batch numbers form a batch of their own, which comes first.
    """
    rows = materialise(keyed(chunks, ["pos", batch]), "copy-keys")
    ledger = Ledger.create(chunks.sparkSession, keys=rows.count())
    # one number a batch; a run has few batches (here 12), whatever the rows
    for (b,) in sorted(rows.select(batch).distinct().collect(), key=lambda r: (r[0] is not None, r[0])):
        ledger.add(rows.where(F.col(batch).eqNullSafe(F.lit(b))))
    return rows, ledger


def found(chunks: DataFrame) -> DataFrame:
    """(first_pos, pos) of every row that is not the first of its copies."""
    rows, ledger = count_copies(chunks)
    kept = materialise(ledger.frame(), "copy-counts")
    ledger.drop()
    return with_first(rows, kept).where("pos <> first_pos").select("first_pos", "pos")


def collapse(chunks: DataFrame) -> DataFrame:
    """One row per distinct chunk: first_pos, n_copies, and the first row's id and chunk.

    Rows with fewer than 20 letters and digits, and null chunks, are left out.
    """
    _, ledger = count_copies(chunks)
    kept = materialise(ledger.frame(), "copy-counts")
    ledger.drop()
    return kept.join(chunks.select(F.col("pos").alias("first_pos"), "id", "chunk"), "first_pos").select("first_pos", "n_copies", "id", "chunk")
