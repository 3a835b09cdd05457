"""Vector search: exact in packed blocks, and by inverted cells.

A block is a few thousand vectors packed into one row as a matrix. Search pairs blocks of
queries with blocks of the corpus, multiplies two matrices in numpy and keeps each query's
best of the block; the best of all blocks are merged by a top-k window. No vector is ever
copied once per query, and neither side has to fit in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.plans.session import cut

from .merge import best

BLOCK = 4096

METRICS = ("ip", "cosine", "l2")


def pack(df: DataFrame, keys: list[str], vector: str, cell: str | None = None, block: int = BLOCK) -> DataFrame:
    """(cell, keys BINARY int64, matrix BINARY float64, width): blocks of the rows with a usable vector, of one cell and width each.

    Keys are whole numbers, one or more a row. Null and empty vectors are left out, as are those
    that hold null, NaN or infinite parts. Without a cell column all rows are of cell 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("_vector")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            width = pa.compute.list_value_length(column).to_numpy()
            ends = np.cumsum(width)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            ok = bad[ends] == bad[ends - width]
            names = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            cells = batch.column("_cell").to_numpy()
            order = np.lexsort((width, cells))
            order = order[ok[order]]
            change = np.flatnonzero((np.diff(cells[order]) != 0) | (np.diff(width[order]) != 0)) + 1
            for rows in np.split(order, change):
                for lo in range(0, len(rows), block):
                    part = rows[lo : lo + block]
                    w = int(width[part[0]])
                    matrix = flat[(ends[part] - w)[:, None] + np.arange(w)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(cells[part[0]])], pa.int64()), pa.array([names[part].tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary()), pa.array([w], pa.int32())],
                        names=["cell", "keys", "matrix", "width"],
                    )

    ok = F.col(vector).isNotNull() & (F.size(vector) > 0)
    for k in keys:
        ok &= F.col(k).isNotNull()
    at = F.lit(0) if cell is None else F.col(cell)
    if cell is not None:
        ok &= F.col(cell).isNotNull()
    rows = df.where(ok).select(*(F.col(k).cast("bigint").alias(k) for k in keys), F.col(vector).alias("_vector"), at.cast("bigint").alias("_cell"))
    return rows.mapInArrow(run, "cell bigint, keys binary, matrix binary, width int")


def scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all query and corpus rows, larger is nearer (squared distance is negated)."""
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    if metric == "l2":
        return -(((q * q).sum(axis=1)[:, None]) - 2 * (q @ c.T) + (c * c).sum(axis=1)[None, :])
    return q @ c.T


def _best_of_blocks(metric: str, k: int, digits: int, q_keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qk, qm, ck, cm, w in zip(*(batch.column(c).to_pylist() for c in ("q_keys", "q_matrix", "keys", "matrix", "width")), strict=True):
                q_no, c_no = np.frombuffer(qk, np.int64).reshape(-1, len(q_keys)), np.frombuffer(ck, np.int64)
                c_order = np.argsort(c_no, kind="stable")
                q, c, c_no = np.frombuffer(qm, np.float64).reshape(-1, w), np.frombuffer(cm, np.float64).reshape(-1, w)[c_order], c_no[c_order]
                for lo in range(0, len(q), 512):
                    s = np.round(scores(q[lo : lo + 512], c, metric), digits) + 0.0
                    at = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    r = np.repeat(np.arange(len(s)), at.shape[1])
                    cols = [pa.array(np.ascontiguousarray(q_no[lo + r, j])) for j in range(len(q_keys))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(c_no[at.reshape(-1)]), pa.array(s[r, at.reshape(-1)])], names=[*q_keys, "pos", "score"])

    return run


#: Query blocks are broadcast up to so many bytes; beyond it, pairs of blocks are spread over a grid.
BROADCAST_BYTES = 64 << 20


def block_pairs(queries: DataFrame, corpus: DataFrame, limit: int | None = None) -> DataFrame:
    """Every block of the queries (q_keys, q_matrix) with every block of the corpus of the same cell and width.

    Few query blocks, by their measured size, are broadcast and the corpus stays where it is. Else both
    sides are spread over a grid: a corpus block lies in one column of it and is sent to every row,
    a query block lies in one row and is sent to every column. So no cell and no width, however
    common, meets in one task.
    """
    spark = queries.sparkSession
    q = queries.select("cell", "width", F.col("keys").alias("q_keys"), F.col("matrix").alias("q_matrix"))
    size = q.agg(F.coalesce(F.sum(F.length("q_matrix")), F.lit(0))).first()[0]
    limit = BROADCAST_BYTES if limit is None else limit
    if size <= limit:
        return corpus.join(F.broadcast(q), ["cell", "width"])
    rows = int(size // max(limit, 1)) + 1
    columns = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // rows))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("row", place("q_keys", rows)).withColumn("column", every(columns))
    c = corpus.withColumn("column", place("keys", columns)).withColumn("row", every(rows))
    return c.join(q, ["cell", "width", "row", "column"]).drop("row", "column")


def search(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", q_key: str | list[str] = "qid", q_vector: str = "vector", key: str = "pos", vector: str = "vector", digits: int = 6, cell: str | None = None
) -> DataFrame:
    """(query keys, pos, score, rk): each query's k best corpus rows, of its own cell if both sides carry one. Equal rounded scores go to the smaller pos.

    l2 scores are negated squared distances. Fewer than k rows come out only if the corpus has fewer.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    q_keys = [q_key] if isinstance(q_key, str) else list(q_key)
    # written: the size is measured first, and the queries are not packed again
    q = cut(pack(queries, q_keys, q_vector, cell))
    pairs = block_pairs(q, pack(corpus, [key], vector, cell)).select("q_keys", "q_matrix", "keys", "matrix", "width")
    schema = ", ".join(f"`{n}` bigint" for n in q_keys) + ", pos bigint, score double"
    near = pairs.mapInArrow(_best_of_blocks(metric, k, digits, q_keys), schema)
    return best(near, q_keys, [F.desc("score"), F.asc("pos")], k)


def index_plan(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """n_vectors, nlist and kind of the index that a corpus gets: flat below 39 vectors, else up to 128 cells of at least 39."""
    n = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).agg(F.count("*").alias("n_vectors"))
    cells = F.floor(F.col("n_vectors") / 39)
    return n.select(
        "n_vectors",
        F.when(cells >= 1, F.least(cells, F.lit(128))).otherwise(F.lit(1)).cast("bigint").alias("nlist"),
        F.when(cells >= 1, F.lit("ivf")).otherwise(F.lit("flat")).alias("kind"),
        F.when(cells >= 1, F.lit("l2")).otherwise(F.lit("ip")).alias("metric"),
    )


def train_cells(corpus: DataFrame, nlist: int, key: str = "pos", vector: str = "vector", sample_rows: int = 20_000, seed: int = 1) -> pd.DataFrame:
    """Centroids (cell, centroid) of k-means over a bounded sample, drawn by a hash of the key; at most nlist rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = corpus.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    # a hash range of about the size of the sample is filtered before it is sorted
    share = (1.2 * sample_rows + 8 * sample_rows**0.5) / max(usable.count(), 1)
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    sample = (usable if share >= 1 else usable.where(hashed < int(share * (1 << 40)))).orderBy(hashed, key).limit(sample_rows)
    if nlist < 2:
        rows = [r[0] for r in sample.select(F.col(vector).cast("array<double>")).collect()]  # bounded by sample_rows
        return pd.DataFrame({"cell": [0], "centroid": [np.mean(rows, axis=0).tolist()]} if rows else {"cell": [], "centroid": []})
    points = sample.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    centres = KMeans(k=nlist, seed=seed, maxIter=10).fit(points).clusterCenters()
    return pd.DataFrame({"cell": range(len(centres)), "centroid": [list(map(float, c)) for c in centres]})


def assign_cells(df: DataFrame, centroids: list[tuple[int, list[float]]], vector: str = "vector", metric: str = "ip", out: str = "cell") -> DataFrame:
    """df with the number of the nearest centroid (null for null and empty vectors). The centroids, at most 128, travel with the task."""
    cells = np.array([c for c, _ in centroids], np.int64)
    matrix = np.array([v for _, v in centroids], np.float64)

    @F.pandas_udf("bigint")
    def nearest(col: pd.Series) -> pd.Series:
        ok = col.map(lambda v: v is not None and len(v) == matrix.shape[1])
        result = pd.Series([None] * len(col), dtype=object)
        if ok.any():
            s = np.round(scores(np.stack(col[ok].to_list()).astype(np.float64), matrix, metric), 9)
            result[ok.to_numpy()] = cells[s.argmax(axis=1)]
        return result

    return df.withColumn(out, nearest(F.col(vector)))


def search_cells(queries: DataFrame, corpus: DataFrame, k: int, q_key: str = "qid", q_vector: str = "vector", key: str = "pos", vector: str = "vector", digits: int = 6) -> DataFrame:
    """(qid, pos, distance, rk): the k nearest by squared distance within each query's own cell. Both sides carry `cell`.

    Rows are packed in blocks of one cell, and a cell with many blocks is spread over the tasks.
    """
    hits = search(queries, corpus, k, "l2", q_key, q_vector, key, vector, digits, "cell")
    return hits.select(q_key, "pos", (0.0 - F.col("score")).alias("distance"), "rk")


def pad_hits(hits: DataFrame, corpus: DataFrame, k: int, key: str = "pos") -> DataFrame:
    """Hits of every query filled up to k with the corpus's last row, as an index does that returns -1 beyond its size."""
    last = corpus.agg(F.max(key)).first()[0]
    have = hits.groupBy("qid").agg(F.count("*").cast("int").alias("n"))
    fill = have.where(F.col("n") < k).select("qid", F.lit(last).cast("bigint").alias("pos"), F.lit(None).cast("double").alias("score"), F.explode(F.sequence(F.col("n") + 1, F.lit(k))).alias("rk"))
    return hits.select("qid", "pos", "score", "rk").unionByName(fill)
