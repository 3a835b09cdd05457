"""Problem 5: the most similar vectors of every vector, by multi-index hashing.

Vectors get binary codes from learned rotations (iterative quantisation, fitted on a bounded
sample). A code is cut into substrings; by the pigeonhole principle two codes that differ in
fewer bits than there are substrings agree in one of them entirely, so looking up each
substring in its own index finds every code within that Hamming radius. Records that meet in
a bucket are reranked by cosine similarity in double precision, and each keeps its best in
the bucket; the best of all buckets are merged.

Substrings grow with the logarithm of the number of records, so buckets keep their size, as long
as the recall allows it: the true neighbours of a bounded sample of records are found by brute
force over all records, and substrings are shortened until RECALL_TARGET of these pairs share
a bucket. Every record is indexed and searched, whatever the sample.
A bucket that is large all the same is worked off in tiles of two blocks: a tile is all a task
ever holds, and the tiles together still compare everything in the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, materialise, out_batch

WIDTH, NEIGHBOURS = 64, 5

#: Vectors that the rotations are fitted on, drawn by a hash of the id.
SAMPLE_ROWS = 20_000

#: Substrings of a code: codes within Hamming distance SUBSTRINGS - 1 are all found.
SUBSTRINGS = 6

#: Share of the true neighbours of MEASURED records, drawn by a hash, that must share a bucket.
RECALL_TARGET, MEASURED = 0.99, 400

#: Rows of a block. A bucket of more than 2 * BLOCK rows is tiled.
BLOCK = 2048

#: Hot buckets are those with more than 1/HOT_PARTS of all rows, so at most HOT_PARTS a substring.
HOT_PARTS = 2000


def usable(vectors: DataFrame) -> DataFrame:
    """One row per id with a usable vector: (no, id, v BINARY of float32), no = smallest vec_no.

    Left out: null ids, null or short vectors, null, NaN or infinite parts, all zeros. If records
    of one id have different vectors, the one with the smallest vec_no counts.
    """
    v = F.col("vector")
    good = v.isNotNull() & (F.size(v) == WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("vector")
            if not batch.num_rows:
                continue
            x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, WIDTH)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            kept = x[ok]
            body = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer((np.arange(len(kept) + 1) * WIDTH * 4).astype(np.int32)), pa.py_buffer(kept.tobytes())])
            mask = pa.array(ok)
            yield out_batch({"no": batch.column("vec_no").filter(mask), "id": batch.column("id").filter(mask), "v": body})

    rows = vectors.where(good & F.col("id").isNotNull()).select("vec_no", "id", "vector").mapInArrow(run, "no bigint, id string, v binary")
    return rows.groupBy("id").agg(F.min("no").alias("no"), F.min_by("v", "no").alias("v")).select("no", "id", "v")


def _floats(col: pa.Array) -> np.ndarray:
    off = np.frombuffer(col.buffers()[1], np.int32)
    lo, hi = off[col.offset], off[col.offset + len(col)]
    return np.frombuffer(col.buffers()[2], np.uint8)[lo:hi].view(np.float32).reshape(len(col), WIDTH)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_rotations(x: np.ndarray, bits: int, rounds: int = 25, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix of WIDTH x bits): rotations that bring centred unit vectors close to the corners of a cube.

    More bits than dimensions come from further rotations with other starting points.
    """
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0) if len(x) else np.zeros(WIDTH)
    z = x - mean
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.normal(size=(WIDTH, WIDTH)))[0]
        for _ in range(rounds if len(z) else 0):
            u, _, vt = np.linalg.svd(np.sign(z @ r).T @ z)
            r = (u @ vt).T
        parts.append(r)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def substring_bits(rows: int) -> int:
    """Bits of a substring: log2 of rows / 16, at least 8."""
    return min(max(8, math.ceil(math.log2(max(rows, 1) / 16 + 1))), 32)


#: Substrings are never shorter than this.
LEAST_BITS = 4


def true_neighbours(base: DataFrame, k: int, queries: int = MEASURED) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of sampled records, and of the k nearest others of each (queries, k, WIDTH), by one pass over all records. Missing ones are NaN."""
    drawn = hashed_sample(base, "no", queries).select("no", "v").toArrow()
    names = drawn.column("no").to_numpy()
    q = np.concatenate([_unit(_floats(c)) for c in drawn.column("v").chunks if len(c)])
    held = base.sparkSession.sparkContext.broadcast((names, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = held.value
        best = np.full((len(q), k), -2.0)
        near = np.zeros((len(q), k, WIDTH), np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _floats(batch.column("v"))
            s = q @ _unit(v).T
            s[names[:, None] == batch.column("no").to_numpy()[None, :]] = -2
            every = np.concatenate((best, s), axis=1)
            at = np.argpartition(-every, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(every, at, axis=1)
            fresh = at >= k
            r, c = np.nonzero(fresh)
            kept = np.take_along_axis(near, np.minimum(at, k - 1)[:, :, None], axis=1)
            kept[r, c] = v[at[r, c] - k]
            near = kept
        r, c = np.nonzero(best > -1.5)
        yield out_batch({"q": r.astype(np.int32), "score": best[r, c], "v": pa.array([x.tobytes() for x in near[r, c]], pa.binary())})

    # queries * k rows a task at most
    top = base.select("no", "v").mapInArrow(run, "q int, score double, v binary").groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "v"))), 1, k).alias("top"))
    out = np.full((len(q), k, WIDTH), np.nan)
    for r in top.collect():
        for j, hit in enumerate(r["top"]):
            out[r["q"], j] = _unit(np.frombuffer(hit["v"], np.float32)[None, :])[0]
    return q, out


def measured_recall(q: np.ndarray, near: np.ndarray, mean: np.ndarray, matrix: np.ndarray, most: int) -> dict[int, float]:
    """Share of the true neighbours that share a bucket with their record, for each length of substring from LEAST_BITS on."""
    ok = np.isfinite(near[:, :, 0])
    bit = lambda x: ((x - mean) @ matrix > 0).reshape(*x.shape[:-1], SUBSTRINGS, most)
    same = bit(q)[:, None] == bit(np.nan_to_num(near))
    # the length of the common beginning of each substring
    reach = np.where(same.all(axis=-1), most, same.argmin(axis=-1)).max(axis=-1)[ok]
    return {b: float((reach >= b).mean()) if len(reach) else 1.0 for b in range(min(LEAST_BITS, most), most + 1)}


def substrings(x: np.ndarray, mean: np.ndarray, matrix: np.ndarray, bits: int) -> np.ndarray:
    """SUBSTRINGS values of `bits` bits for each unit vector."""
    code = ((x - mean) @ matrix > 0).reshape(len(x), -1, bits)
    return code @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(q, c, score): for each usable record its up to k most similar others; and the usable records.

    q and c are the records' numbers. Ties go to the smaller number.
    """
    spark = vectors.sparkSession
    base = materialise(usable(vectors), "knn-base")
    rows = base.count()
    sample = hashed_sample(base, "no", sample_rows).select("v").toArrow().column("v")
    x = np.concatenate([_unit(_floats(c)) for c in sample.chunks if len(c)]) if len(sample) else np.zeros((0, WIDTH))
    most = substring_bits(rows)
    mean, matrix = fit_rotations(x, most * SUBSTRINGS)
    bits = most
    if rows:
        recall = measured_recall(*true_neighbours(base, k), mean, matrix, most)
        bits = max((b for b, r in recall.items() if r >= RECALL_TARGET), default=LEAST_BITS)
    # shorter substrings are the first bits of each
    matrix = matrix.reshape(WIDTH, SUBSTRINGS, most)[:, :, :bits].reshape(WIDTH, -1)
    model = spark.sparkContext.broadcast((mean, matrix, bits))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, matrix, bits = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sub = substrings(_unit(_floats(batch.column("v"))), mean, matrix, bits) * SUBSTRINGS + np.arange(SUBSTRINGS)
            at = pa.array(np.repeat(np.arange(batch.num_rows), SUBSTRINGS))
            cols = {"bucket": sub.reshape(-1), "no": batch.column("no").take(at)}
            if "v" in wanted:
                cols["v"] = batch.column("v").take(at)
            yield out_batch(cols)

    wanted = ()
    counts = base.select("no", "v").mapInArrow(index, "bucket bigint, no bigint").groupBy("bucket").agg(F.count("*").alias("rows"))
    hot_at = max(2 * BLOCK, rows // HOT_PARTS)
    hot = materialise(counts.where(F.col("rows") > hot_at), "knn-hot")  # at most HOT_PARTS * SUBSTRINGS rows
    wanted = ("v",)
    entries = base.select("no", "v").mapInArrow(index, "bucket bigint, no bigint, v binary").join(F.broadcast(hot), "bucket", "left")
    blocks = F.coalesce(F.ceil(F.col("rows") / BLOCK), F.lit(1)).cast("int")
    entries = entries.withColumn("n", blocks).withColumn("own", F.pmod(F.xxhash64("no"), F.col("n")).cast("int"))
    # tile (i, j), i <= j, of a bucket with n blocks gets the rows of blocks i and j
    tiles = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "bucket", (F.least("own", "other") * F.col("n") + F.greatest("own", "other")).alias("tile"), "own", "no", "v"
    )
    sorted_tiles = tiles.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            got = best_of_tile(*group, k)
            if got is not None:
                yield out_batch({"q": got[0], "c": got[1], "score": got[2]})

    near = sorted_tiles.mapInArrow(search, "q bigint, c bigint, score double").groupBy("q", "c").agg(F.max("score").alias("score"))
    ranked = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "c"))), 1, k).alias("top"))
    # a record has at most k pairs from each tile of its SUBSTRINGS buckets
    return ranked.select("q", F.explode("top").alias("top")).select("q", "top.c", (-F.col("top.d")).alias("score")), base


def _groups(batches: Iterator[pa.RecordBatch], chunk: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole (bucket, tile) groups, several at a time, from batches sorted by them: group number, block, no, vectors."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = (batch.column("bucket").to_numpy(), batch.column("tile").to_numpy(), batch.column("own").to_numpy(), batch.column("no").to_numpy(), _floats(batch.column("v")))
        held.append(part)
        size += batch.num_rows
        if size < chunk:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        # the last group may go on in the next batch
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield _numbered([c[:cut] for c in cols])
        held, size = [tuple(c[cut:].copy() for c in cols)], len(cols[0]) - cut
    if size:
        yield _numbered([np.concatenate(c) for c in zip(*held, strict=True)])


def _numbered(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    change = np.concatenate(([False], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
    return np.cumsum(change), cols[2], cols[3], cols[4]


def best_of_tile(group: np.ndarray, own: np.ndarray, no: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(q, c, score) of each row's up to k best others in its group.

    A tile of two different blocks compares only rows of unlike blocks: the others meet in the tile of their own block.
    """
    x = _unit(v)
    out: list[tuple] = []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    for lo, hi in zip(starts, [*starts[1:], len(group)], strict=True):
        m = hi - lo
        if m < 2:
            continue
        xs, mine, names = x[lo:hi], own[lo:hi], no[lo:hi]
        mixed = mine.min() != mine.max()
        order = np.argsort(names)  # ties go to the smaller number
        xs, mine, names = xs[order], mine[order], names[order]
        for a in range(0, m, 512):
            s = xs[a : a + 512] @ xs.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
            if mixed:
                s[mine[a : a + 512, None] == mine[None, :]] = -2
            kk = min(k, m - 1)
            at = np.argpartition(-s, kk - 1, axis=1)[:, :kk] if kk < m - 1 else np.argsort(-s, axis=1, kind="stable")[:, :kk]
            sc = np.take_along_axis(s, at, axis=1)
            r, c = np.nonzero(sc > -1.5)
            out.append((names[a + r], names[at[r, c]], sc[r, c]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else None


def found(vectors: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one record is among the 5 most similar of the other."""
    near, base = neighbours(vectors)
    a = base.select(F.col("no").alias("q"), F.col("id").alias("qid"))
    b = base.select(F.col("no").alias("c"), F.col("id").alias("cid"))
    pairs = near.select(F.least("q", "c").alias("q"), F.greatest("q", "c").alias("c")).distinct()
    return pairs.join(a, "q").join(b, "c").select(F.least("qid", "cid").alias("id_a"), F.greatest("qid", "cid").alias("id_b"))


def neighbour_lists(vectors: DataFrame) -> DataFrame:
    """(vec_no, neighbour_no, similarity) for the records whose number is divisible by 50, searched against all records."""
    near, _ = neighbours(vectors)
    return near.where("q % 50 = 0").select(F.col("q").alias("vec_no"), F.col("c").alias("neighbour_no"), F.round("score", 6).alias("similarity"))
