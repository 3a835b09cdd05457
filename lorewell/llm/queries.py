"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import boilerplate

    return boilerplate.found(_t(spark, sf_dir, "web_results"))


def p1_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import boilerplate

    return boilerplate.label(_t(spark, sf_dir, "web_results"), keep=("url",)).select("page_id", "url", "body")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mojibake

    return mojibake.found(_t(spark, sf_dir, "web_results"))


def p2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mojibake

    return mojibake.repair(_t(spark, sf_dir, "web_results"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import copies

    return copies.found(_t(spark, sf_dir, "semantic_chunk_output"))


def p3_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import copies

    return copies.collapse(_t(spark, sf_dir, "semantic_chunk_output"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import forest

    return forest.found(_t(spark, sf_dir, "semantic_chunk_output"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import splitting

    return splitting.found(_t(spark, sf_dir, "semantic_chunk_output"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import splitting

    return splitting.split_table(_t(spark, sf_dir, "semantic_chunk_output").select("pos", "chunk"), "pos", "chunk")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.found(_t(spark, sf_dir, "semantic_chunk_output"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.groups(_t(spark, sf_dir, "semantic_chunk_output"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import knn

    return knn.found(_t(spark, sf_dir, "semantic_chunk_vector"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import knn

    return knn.neighbour_lists(_t(spark, sf_dir, "semantic_chunk_vector"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import leakage

    return leakage.found(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import leakage

    return leakage.leaked_items(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "eval_items"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mixture(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing
    from .common import materialise

    targets = _t(spark, sf_dir, "mix_targets")
    mixed = materialise(mixing.mixture(_t(spark, sf_dir, "documents"), targets), "mixture")
    return mixing.shares(mixed, targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repetition

    return repetition.found(_t(spark, sf_dir, "documents"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repetition

    return repetition.measure(_t(spark, sf_dir, "documents")).select("doc_id", (F.round("repeated_share", 6) + 0.0).alias("repeated_share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return SQL
