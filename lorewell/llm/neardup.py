"""Problem 4: near-duplicate chunks, by bottom-k sketches from one hash function.

A chunk's sketch is the SKETCH smallest hashes of its distinct runs of 8 letters and digits.
The inverted lists hold runs of three neighbouring retained values rather than single ones:
a pair above the threshold keeps about 0.7 ** 3 of them in common, while two chunks that only
share common phrases almost never have three neighbours in common, so the lists stay short
at any corpus size. LISTED of a chunk's runs (those of smallest hash) are listed; small sets,
which have few runs, are also listed by runs of two, and the smallest by single values. With
`exact` every single retained value is listed, so that no two sketches that overlap are missed.

Lists that many chunks are in, told from a sample of the chunks, are worked off in tiles of two
blocks each, so that no list meets in one task; the tiles together compare the whole list.

Pairs that meet in a list are estimated by the sketch of their union and, unless clearly
below, verified by the exact Jaccard similarity of the whole sets. Equal texts are one text
in all of this; the result is expanded to rows at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialise, out_batch, rows_at, slices
from .minhash import min_bits
from .records import keyed

SHINGLE, THRESHOLD = 8, 0.7
SKETCH, LISTED = 64, 32

#: The union sketch may be this far below the threshold before a pair is dropped: over four standard deviations.
MARGIN = 0.26

#: A list of more chunks than this is worked off in tiles, and hot lists are looked for in one of so many chunks.
HOT_LIST, LOOKED_AT = 2000, 16

#: Most hot lists there can be: the bound of a hot list grows with the corpus where there would be more.
HOT_LISTS = 50_000

_PAD = np.uint64(1 << 62)


def sketches(sets: np.ndarray, cuts: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The `size` smallest hashes of each set, ascending, padded with 2**62."""
    n = np.diff(cuts)
    cols = np.arange(size)
    at = np.minimum(cuts[:-1, None] + cols, max(len(sets) - 1, 0))
    return np.where(cols < n[:, None], sets[at] if len(sets) else _PAD, _PAD)


def union_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of each pair of sketches: share of the smallest SKETCH values of the union that are in both."""
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < _PAD)
    rank = np.cumsum(~twice, axis=1)
    size = np.minimum(a.shape[1], (~twice & (both < _PAD)).sum(axis=1))
    return (twice & (rank <= size[:, None])).sum(axis=1) / np.maximum(size, 1)


def list_keys(sketch: np.ndarray, n: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every inverted list that a row enters."""
    rows, keys = [], []
    kinds = ((1, None, SKETCH),) if exact else ((3, None, LISTED), (2, SKETCH / THRESHOLD, SKETCH), (1, SKETCH / THRESHOLD / 2, SKETCH))
    for width, most, listed in kinds:
        h = K.mix(np.uint64(width) + sum(K.mix(sketch[:, i : sketch.shape[1] - width + 1 + i] + np.uint64(i)) for i in range(width)))
        h = np.where(sketch[:, width - 1 :] < _PAD, h, np.uint64(0xFFFFFFFFFFFFFFFF))
        if listed < h.shape[1]:
            h = np.partition(h, listed - 1, axis=1)[:, :listed]
        use = h != np.uint64(0xFFFFFFFFFFFFFFFF)
        if most is not None:
            use &= (n < most)[:, None]
        r, c = np.nonzero(use)
        rows.append(r)
        keys.append(h[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def listings(chunks: DataFrame, text: str = "chunk", exact: bool = False) -> DataFrame:
    """(h, t, n, bits): list, key of the text, number of its distinct shingles, its one-bit min-hashes; a text once per Arrow slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            codes, off = K.fold(batch.column("_text"))
            t = K.text_keys(codes, off)
            sets, cuts = K.shingle_sets(codes, off, SHINGLE)
            n = np.diff(cuts)
            once = np.zeros(len(t), bool)
            once[np.unique(t, return_index=True)[1]] = True
            once &= np.diff(off) >= 20
            sk, t, n, bits = sketches(sets, cuts)[once], t[once], n[once], min_bits(sets, cuts)[once]
            row, h = list_keys(sk, n, exact)
            yield out_batch({"h": K.signed(h), "t": K.signed(t[row]), "n": n[row].astype(np.int32), "bits": K.signed(bits[row])})

    return chunks.select(F.col(text).alias("_text")).where(F.col("_text").isNotNull()).mapInArrow(run, "h bigint, t bigint, n int, bits bigint")


def hot_lists(chunks: DataFrame, exact: bool = False) -> DataFrame:
    """(h, blocks): lists that hold about HOT_LIST texts or more, from one of LOOKED_AT chunks; at most HOT_LISTS rows.

    Only how a list is worked off depends on it, never what comes out.
    """
    part = chunks.where(F.pmod(F.xxhash64("pos"), F.lit(LOOKED_AT)) == 0)
    entries = listings(part, exact=exact).groupBy("h").agg(F.count_distinct("t").alias("n"))
    texts = chunks.count()
    at = max(HOT_LIST // LOOKED_AT, texts * 2 * SKETCH // LOOKED_AT // HOT_LISTS)
    return materialise(entries.where(F.col("n") >= at).select("h", F.ceil(F.col("n") / at).cast("int").alias("blocks")), "near-hot")


def candidates(entries: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (ta < tb) of texts that meet in a list and whose sizes and one-bit min-hashes allow the threshold.

    At the threshold T the bits differ with chance (1 - T) / 2; a pair passes up to four standard
    deviations more, where a set of n shingles fills about 64 * (1 - exp(-n / 64)) of the 64 bins.
    """
    # one exchange by list serves both the removal of repeated texts and the self-join
    once = entries.repartition("h").dropDuplicates(["h", "t"])
    on, apart_from = ["h"], F.lit(True)
    if hot is not None and not hot.isEmpty():
        # tile (i, j), i <= j, of a list of n blocks gets the texts of blocks i and j
        n = F.coalesce("blocks", F.lit(1))
        own = once.join(F.broadcast(hot), "h", "left").withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
        tiles = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        once = tiles.withColumn("tile", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).withColumn("within", F.col("own") == F.col("other"))
        on, apart_from = ["h", "tile"], (F.col("oa") != F.col("ob")) | F.col("wa") & F.col("wb")
    else:
        once = once.withColumn("own", F.lit(0)).withColumn("within", F.lit(True))
    side = lambda x: once.select(*on, *(F.col(c).alias(a + x) for c, a in (("t", "t"), ("n", "n"), ("bits", "b"), ("own", "o"), ("within", "w"))))
    near = (F.col("na") >= F.col("nb") * THRESHOLD) & (F.col("nb") >= F.col("na") * THRESHOLD)
    apart = (1 - THRESHOLD) / 2
    bins = 1 - F.exp(-F.least("na", "nb") / 64.0)
    alike = F.bit_count(F.col("ba").bitwiseXOR(F.col("bb"))) <= 64 * apart + 4 * F.sqrt(64 * apart * (1 - apart) / bins)
    return side("a").join(side("b"), on).where((F.col("ta") < F.col("tb")) & apart_from & near & alike).select("ta", "tb").distinct()


def verify(pairs: DataFrame, keep: list[str], schema: str, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (columns text_a, text_b and `keep`) whose exact Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", 2_000_000):
            part = []
            for side in ("text_a", "text_b"):
                part.append(K.shingle_sets(*K.fold(batch.column(side)), SHINGLE))
            (ha, oa), (hb, ob) = part
            maybe = union_estimate(sketches(ha, oa), sketches(hb, ob)) >= threshold - MARGIN
            same = np.zeros(len(maybe))
            same[maybe] = K.pair_jaccard(ha, oa, hb, ob)[maybe]
            yield batch.select(keep).filter(pa.array(same >= threshold))

    return pairs.select(*keep, "text_a", "text_b").mapInArrow(run, schema)


def similar_texts(chunks: DataFrame, rows: DataFrame, exact: bool = False) -> DataFrame:
    """(ta, tb): keys of distinct texts with a similarity of at least THRESHOLD."""
    first = rows.groupBy("t").agg(F.min("pos").alias("pos"))
    # written: the verification reads it twice, and the lists need not be built again
    pairs = materialise(candidates(listings(chunks, exact=exact), hot_lists(chunks, exact)), "near-pairs")
    end = lambda t, p: first.select(F.col("t").alias(t), F.col("pos").alias(p))
    placed = materialise(pairs.join(end("ta", "pa"), "ta").join(end("tb", "pb"), "tb"), "near-placed")
    need = materialise(placed.select(F.col("pa").alias("pos")).unionByName(placed.select(F.col("pb").alias("pos"))).distinct(), "near-need")
    texts = rows_at(chunks.select("pos", "chunk"), "pos", need)
    both = placed.join(texts.select(F.col("pos").alias("pa"), F.col("chunk").alias("text_a")), "pa").join(
        texts.select(F.col("pos").alias("pb"), F.col("chunk").alias("text_b")), "pb"
    )
    return verify(both, ["ta", "tb"], "ta bigint, tb bigint")


def found(chunks: DataFrame, exact: bool = False) -> DataFrame:
    """(pos_a, pos_b), pos_a < pos_b: similar rows that are not copies of each other. exact: by every single retained value.

    Null texts and texts with fewer than 20 letters and digits match nothing.
    """
    rows = materialise(keyed(chunks, ["pos"]), "near-rows")
    links = materialise(similar_texts(chunks, rows, exact), "near-links")
    a = rows.select(F.col("t").alias("ta"), F.col("pos").alias("pa"), F.col("k1").alias("ka1"), F.col("k2").alias("ka2"))
    b = rows.select(F.col("t").alias("tb"), F.col("pos").alias("pb"), F.col("k1").alias("kb1"), F.col("k2").alias("kb2"))
    return (
        links.join(a, "ta")
        .join(b, "tb")
        .where("ka1 <> kb1 OR ka2 <> kb2")
        .select(F.least("pa", "pb").alias("pos_a"), F.greatest("pa", "pb").alias("pos_b"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge list (a, b): the smallest node of its component.

    Alternating large-star and small-star steps; each round's edges are written to the shared
    folder, and the steps end when nothing changes. A node that links a third of all others is
    only ever aggregated (its minimum, combined map-side), never collected.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(low, "a")
        if large:
            out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:  # about log(longest path) rounds
        edges = materialise(star(star(edges, True), False), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def groups(chunks: DataFrame) -> DataFrame:
    """One row per chunk row that has copies or similar rows: pos, group_pos (smallest pos of its group), n_links.

    Groups are the connected components of "similar or copy"; n_links counts the distinct other
    texts that the row's text is similar to.
    """
    rows = materialise(keyed(chunks, ["pos"]), "near-rows")
    links = materialise(similar_texts(chunks, rows), "near-links")
    first = rows.groupBy("t", "k1", "k2").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    low = first.groupBy("k1", "k2").agg(F.min("pos").alias("low"))
    texts = materialise(first.join(low, ["k1", "k2"]).select("t", "low", "pos", "n"), "near-texts")
    node = lambda side: texts.select(F.col("t").alias(side), F.col("low").alias("p" + side))
    edges = links.join(node("ta"), "ta").join(node("tb"), "tb").select(F.col("pta").alias("a"), F.col("ptb").alias("b"))
    root = components(edges)
    degree = links.select("ta").unionByName(links.select(F.col("tb").alias("ta"))).groupBy("ta").agg(F.count("*").alias("n_links")).withColumnRenamed("ta", "t")
    labelled = texts.join(root.withColumnRenamed("node", "low"), "low", "left").join(degree, "t", "left")
    many = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    labelled = labelled.select("t", F.coalesce("root", "low").alias("group_pos"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return (
        rows.join(many.where("copies > 1"), ["k1", "k2"], "left")
        .join(labelled, "t")
        .where("copies > 1 OR n_links > 0")
        .select("pos", "group_pos", "n_links")
    )
