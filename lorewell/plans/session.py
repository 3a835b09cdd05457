"""Session helpers: table access and shipping the package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors, unless PYTHONPATH already does it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    out = tempfile.mkdtemp(prefix="lorewell-ship-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{out}/lorewell", "zip", ROOT, "lorewell"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir. Where that is unset a temporary one is used on a local master, and only there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lorewell-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A frame whose plan is cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    at = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint()
