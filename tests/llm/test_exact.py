"""Problems with exact definitions, against brute force on small made-up tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.llm import copies, forest, kernels, knn, leakage, minhash, mixing, neardup, repetition, splitting, trees
from lorewell.llm.records import letters, record_fields

WORDS = "alpha beta gamma delta clock reset signal counter fifo bridge arbiter pulse edge state 时钟 复位 Überlauf décalage".split()


def made_chunks(n: int = 160, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    texts: list = [None, "", "   ", "short", "。" * 50]
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(rng.randrange(4, 60))) for _ in range(40)]
    while len(texts) < n:
        t = rng.choice(base)
        kind = rng.randrange(6)
        if kind == 0:
            t = t.upper().replace(" ", " , ")
        elif kind == 1:
            w = t.split()
            w[rng.randrange(len(w))] = "edited" + str(rng.randrange(9))
            t = " ".join(w)
        elif kind == 2:
            f = [(f"name_{c}", str(rng.randrange(3)) + " value of the field") for c in "abc"]
            rng.shuffle(f)
            t = rng.choice([json.dumps(dict(f)), "; ".join(f"{k}: {v}" for k, v in f), "\n".join(f"{k} = {v}" for k, v in f)])
        elif kind == 3 and rng.random() < 0.3:
            t = (t + " ") * 60
        texts.append(t)
    rng.shuffle(texts)
    return [(i + 1, f"id{i % 90}", t, i * 5 // n, "extra") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def chunk_rows():
    return made_chunks()


@pytest.fixture(scope="module")
def chunks(spark, chunk_rows):
    return spark.createDataFrame(chunk_rows, "pos bigint, id string, chunk string, batch_no bigint, t string").repartition(5)


def copy_key(text):
    f = record_fields(text)
    return tuple(sorted(set(f))) if f else letters(text)


def usable(rows):
    return {p: c for p, _, c, _, _ in rows if c is not None and len(letters(c)) >= 20}


def shingles(text):
    s = letters(text)
    return {s[i : i + 8] for i in range(len(s) - 7)}


def similar_pairs(rows):
    rows = usable(rows)
    sets, keys = {p: shingles(c) for p, c in rows.items()}, {p: copy_key(c) for p, c in rows.items()}
    return {(a, b) for a in rows for b in rows if a < b and keys[a] != keys[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}


def copy_pairs(rows):
    first, out = {}, set()
    for p, c in sorted(usable(rows).items()):
        f = first.setdefault(copy_key(c), p)
        if f != p:
            out.add((f, p))
    return out


def got(df):
    r = [tuple(x) for x in df.collect()]
    assert len(r) == len(set(r))
    return set(r)


def test_records():
    a = record_fields('{"Name": "x-1", "b": 2}')
    assert set(a) == {("name", "x1"), ("b", "2")}
    assert set(record_fields("b = 2 | Name = X 1")) == set(a) == set(record_fields("name: x1\nb: 2"))
    for text in ("Review note 16: a; Review note 17: b", "one: two", "{broken", "a: b; plain text", "", "{}", "[1]"):
        assert record_fields(text) is None


def test_copies(chunks, chunk_rows):
    want = copy_pairs(chunk_rows)
    assert got(copies.found(chunks)) == want and want
    assert got(copies.found(chunks.limit(0))) == set()
    rows = {r["first_pos"]: r for r in copies.collapse(chunks).collect()}
    assert sum(r["n_copies"] for r in rows.values()) == len(usable(chunk_rows))
    assert {f for f, _ in want} == {p for p, r in rows.items() if r["n_copies"] > 1}


def test_ledger_goes_on(spark, tmp_path):
    """A later session adds to a stored ledger; only buckets of the batch's keys are written again."""
    path = f"file://{tmp_path}/ledger"
    batch = lambda *r: spark.createDataFrame(list(r), "pos bigint, k1 bigint, k2 bigint")
    ledger = copies.Ledger.create(spark, path, buckets=8)
    assert len(ledger.add(batch(*((i, i % 20, 0) for i in range(10, 60))))) > 3
    before = dict(ledger.state["folders"])
    again = copies.Ledger.open(spark, path)
    assert len(again.add(batch((3, 7, 0), (4, 7, 0), (5, 99, 1)))) <= 2 and again.add(batch()) == []
    rows = {(r["k1"], r["k2"]): (r["first_pos"], r["n_copies"]) for r in copies.Ledger.open(spark, path).frame().collect()}
    assert rows[7, 0] == (3, sum(i % 20 == 7 for i in range(10, 60)) + 2) and rows[99, 1] == (5, 1) and len(rows) == 21
    assert sum(again.state["folders"][b] == f for b, f in before.items()) >= len(before) - 2
    with pytest.raises(FileNotFoundError):
        copies.Ledger.open(spark, f"file://{tmp_path}/none")


def test_hot_copies(spark):
    rows = [(i, "x", "The same text in a third of all rows" if i % 3 else f"another text, number {i} of many", i % 4) for i in range(4000)]
    df = spark.createDataFrame(rows, "pos bigint, id string, chunk string, batch_no bigint")
    out = copies.found(df).collect()
    assert {r["first_pos"] for r in out} == {1} and len(out) == sum(1 for r in rows if r[0] % 3) - 1


def test_near_duplicates(chunks, chunk_rows):
    want = similar_pairs(chunk_rows)
    assert got(neardup.found(chunks)) == want and len(want) > 20
    assert got(neardup.found(chunks.limit(0))) == set()


def test_near_duplicates_other_ways(chunks, chunk_rows, monkeypatch):
    """Every single value listed, and every list in tiles, give the same pairs."""
    want = got(neardup.found(chunks))
    assert got(neardup.found(chunks, exact=True)) == want
    monkeypatch.setattr(neardup, "HOT_LIST", 2)
    monkeypatch.setattr(neardup, "LOOKED_AT", 1)
    assert not neardup.hot_lists(chunks).isEmpty()
    assert got(neardup.found(chunks)) == want
    assert got(neardup.found(chunks.limit(0))) == set()


def test_groups(chunks, chunk_rows):
    parent = {p: p for p in usable(chunk_rows)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in similar_pairs(chunk_rows) | copy_pairs(chunk_rows):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for pair in similar_pairs(chunk_rows) | copy_pairs(chunk_rows) for x in pair}
    assert {(r["pos"], r["group_pos"]) for r in neardup.groups(chunks).collect()} == {(p, root(p)) for p in linked}


def test_forest(chunks, chunk_rows):
    batch = {r[0]: r[3] for r in chunk_rows}
    best: dict[int, int] = {}
    keys = {p: copy_key(c) for p, c in usable(chunk_rows).items()}
    pairs = similar_pairs(chunk_rows) | {(a, b) for a in keys for b in keys if a < b and keys[a] == keys[b]}
    for a, b in pairs:
        a, b = sorted((a, b), key=lambda p: batch[p])
        if batch[a] < batch[b]:
            best[b] = min(best.get(b, 1 << 40), a)
    assert got(forest.found(chunks)) == {(m, p) for p, m in best.items()}
    assert got(forest.found(chunks.limit(0))) == set()


def test_forest_is_reopened_and_merged(spark, chunks, chunk_rows, tmp_path, monkeypatch):
    """A later session goes on with the stored forest; merged runs and split prefixes find the same pairs."""
    rows = forest.marks(chunks)
    texts = forest.materialise(forest.texts_of(rows), "texts")
    numbers = sorted(b for (b,) in texts.select("batch_no").distinct().collect())
    assert len(numbers) > 2

    def pairs(path, reopen):
        out, f = set(), forest.Forest.create(spark, path, texts.count())
        for b in numbers:
            if reopen:
                f.close()
                f = forest.Forest.open(spark, path)
            hits = f.search(texts.where(F.col("batch_no") == b))
            out |= got(hits.select("pos", "other_pos", "copy")) if hits is not None else set()
        return out, f

    want, f = pairs(f"file://{tmp_path}/a", False)
    assert want
    f.close()
    again, f = pairs(f"file://{tmp_path}/b", True)
    assert again == want and f.state["runs"] == len(numbers)
    monkeypatch.setattr(forest, "MAX_RUNS", 2)
    monkeypatch.setattr(forest, "HOT_ENTRIES", 1)
    again, f = pairs(f"file://{tmp_path}/c", True)
    assert again == want and f.state["files"] <= 2
    f.drop()
    with pytest.raises(Exception):
        forest.Forest.open(spark, f"file://{tmp_path}/c")


def test_forest_leaves_out_unlike_texts(spark):
    """Texts that share a phrase meet in some tree, as the square of their number; next to none of them goes on to the exact check."""
    rng = random.Random(11)
    phrase = "so that the arbiter of the second clock domain must stay stable for the same number of cycles"
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    rows = [(i, phrase + " " + " ".join(word() for _ in range(28)), i % 2) for i in range(1000)]
    rows += [(1000 + i, rows[2 * i][1] + " edited", 1) for i in range(50)]
    chunks = spark.createDataFrame(rows, "pos bigint, chunk string, batch_no bigint").repartition(4)
    texts = forest.materialise(forest.texts_of(forest.marks(chunks)), "texts")
    f = forest.Forest.create(spark, texts=texts.count())
    assert f.search(texts.where("batch_no = 0")) is None
    pairs = got(f.search(texts.where("batch_no = 1")).select("pos", "other_pos"))
    assert f.state["depth"] == 3  # where unlike texts meet most
    f.drop()
    edited = {(1000 + i, 2 * i) for i in range(50)}
    assert edited <= pairs and len(pairs - edited) <= 10


def test_forest_is_planned_by_its_texts(spark, tmp_path):
    """A forest has buckets for its entries, whatever the shuffle partitions; one with other bits is refused."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        f = forest.Forest.create(spark, f"file://{tmp_path}/few", 1000)
        many = forest.Forest.create(spark, f"file://{tmp_path}/many", 10_000_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert f.state["buckets"] == 16 and 105 <= many.state["buckets"] < 125
    many.drop()
    f.state.pop("bits", None)
    f._save()
    f.close()
    with pytest.raises(ValueError):
        forest.Forest.open(spark, f"file://{tmp_path}/few")


def test_forest_measures_recall(spark):
    seen = lambda once, twice, more: spark.createDataFrame([(i, s) for i, s in enumerate([1] * once + [2] * twice + [5] * more)], "pos int, seen int")
    assert forest.measured_recall(seen(0, 0, 9)) == 1.0
    assert forest.measured_recall(seen(4, 2, 4)) == pytest.approx(10 / 14)
    assert forest.measured_recall(seen(0, 0, 0)) == 1.0


def test_forest_depth_and_signatures():
    assert forest.stop_depth() == 3
    rng = np.random.default_rng(1)
    pool = rng.choice(1 << 44, 3000, replace=False).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[353:2353])  # Jaccard 0.7
    sig = minhash.signatures(np.concatenate((a, b)), np.array([0, 2000, 4000]), 800)
    assert abs((sig[0] == sig[1]).mean() - 0.7) < 0.07
    small = minhash.signatures(np.concatenate((a[:9], a[:9])), np.array([0, 9, 18, 18]), 80)
    assert (small[0] == small[1]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 199)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    out = dict(tuple(r) for r in neardup.components(df).collect())
    assert all(out[i] == 1 for i in range(1, 41)) and all(out[i] == 100 for i in range(100, 130)) and out[200] == 199


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n。,é́", max_size=900), st.integers(20, 90), st.integers(0, 15), st.integers(20, 400))
def test_pieces(text, limit, overlap, width):
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    step, _ = splitting.geometry(limit, overlap)
    width = max(width // step, 1) * step
    pieces = []
    for lo in range(0, max(len(text), 1), width):
        base = max(lo - splitting.halo(limit, overlap), 0)
        pieces += splitting.pieces_of_range(cps[base : lo + width + 1], base, lo, min(lo + width, len(text)), len(text), limit, overlap)
    pieces.sort()
    assert [p[0] for p in pieces] == list(range(len(pieces)))
    back = ""
    for no, a, b in pieces:
        assert 0 < b - a <= limit
        if no:
            assert a == max(len(back) - overlap, 0)
        back = back[:a] + text[a:b]
    assert back == text
    assert sorted(splitting.pieces_of_range(cps, 0, 0, len(text), len(text), limit, overlap)) == pieces


def test_split_table_and_files(spark, tmp_path):
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "end. ", "字。", "x" * 30, "\n\n", "é"]) for _ in range(4000))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x" * 2000), (5, "y" * 2001)], "pos bigint, chunk string")
    out = splitting.split_table(df, "pos", "chunk", range_chars=3000).collect()
    assert {r["pos"] for r in out} == {1, 5}
    pieces = sorted((r["piece_no"], r["start"], r["end"], r["piece"]) for r in out if r["pos"] == 1)
    assert all(text[a:b] == p and len(p) <= 2000 for _, a, b, p in pieces)
    assert sum(p[-1] in ".。\n " for *_, p in pieces) > len(pieces) / 2
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "b.txt").write_text("short", encoding="utf-8")
    (tmp_path / "c.txt").write_text("", encoding="utf-8")
    files = spark.createDataFrame([(str(p), p.stat().st_size) for p in sorted(tmp_path.iterdir()) if p.suffix == ".txt"], "path string, length bigint")
    got_ = splitting.split_files(spark, files, range_bytes=5000).collect()
    assert sorted((r["piece_no"], r["start"], r["end"], r["piece"]) for r in got_ if r["path"].endswith("a.txt")) == pieces
    assert [(r["piece_no"], r["piece"]) for r in got_ if r["path"].endswith("b.txt")] == [(0, "short")]
    assert not [r for r in got_ if r["path"].endswith("c.txt")]


def test_rare_boundaries(spark):
    rng = random.Random(5)
    texts = ["x" * 1620 + " " + "y" * 15 + " " + "z" * 1115, "x" * 7000, "a" * 1900 + " " + "b" * 1900 + " " + "c" * 1900 + " " + "d" * 500]
    texts += ["".join(rng.choice("xyz") * rng.randrange(1, 2600) + rng.choice([" ", "。", ", ", "\n"]) for _ in range(60)) for _ in range(6)]
    texts += ["word and. " * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "pos bigint, chunk string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = {w: sorted(map(tuple, splitting.split_table(df, "pos", "chunk", range_chars=w).collect())) for w in (1 << 18, 2640, 1000)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out[1 << 18] == out[2640] == out[1000]
    hard = 0
    for i, text in enumerate(texts):
        pieces = [r[1:] for r in out[1 << 18] if r[0] == i]
        strength = splitting.boundary_strength(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        assert [p[0] for p in pieces] == list(range(len(pieces))) and pieces[-1][2] == len(text)
        end = 0
        for _, a, b, piece in pieces:
            assert a == max(end - 20, 0) and end < b and piece == text[a:b] and len(piece) <= 2000
            if b < len(text) and strength[b - 1] <= 0:
                assert not (strength[end : end + 1980] > 0).any()  # mid-text only where nothing else is within the limit
                hard += 1
            end = b
    assert hard and [r[2:4] for r in out[1 << 18] if r[0] == 0] == [(0, 1621), (1601, len(texts[0]))]


def brute_leak(doc, item):
    a, b = letters(doc or ""), letters(item or "")
    grams = {b[i : i + 60] for i in range(len(b) - 59)}
    return any(a[i : i + 60] in grams for i in range(len(a) - 59))


@pytest.mark.parametrize("size", [1 << 30, 0])
def test_leakage(spark, size):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n))
    items = [(i, text(30)) for i in range(8)] + [(90, None), (91, ""), (92, "tiny")]
    items.append((93, items[0][1][:150] + text(5)))
    docs = [(0, None), (1, ""), (2, "x")]
    for i in range(3, 50):
        t = text(40)
        s = items[i % 8][1]
        k = letters(s)[: rng.choice([55, 58, 59, 60, 61, 80])]
        docs.append((i, t + (" ".join(k) if i % 2 else s) + text(3)))
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id bigint, text string, item_id string")
    i_ = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    want = {(a, b) for a, x in docs for b, y in items if brute_leak(x, y)}
    assert got(leakage.found(d, i_, size)) == want and len(want) > 20
    assert got(leakage.found(d.limit(0), i_, size)) == set() == got(leakage.found(d, i_.limit(0), size))


def brute_share(text):
    s = letters(text or "")
    seen, hit = set(), [False] * len(s)
    for i in range(len(s) - 19):
        if s[i : i + 20] in seen:
            hit[i : i + 20] = [True] * 20
        seen.add(s[i : i + 20])
    return sum(hit) / len(s) if s else 0.0


def test_repetition(spark):
    rng = random.Random(6)
    rows = [(0, None), (1, ""), (2, "ab"), (3, "a" * 5000)]
    for i in range(4, 300):
        t = " ".join(rng.choice(WORDS) + str(rng.randrange(9999)) for _ in range(rng.randrange(5, 80)))
        rows.append((i, t + ". " + t[: int(len(t) * rng.random())] if i % 3 == 0 else t))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in repetition.measure(df).collect()}
    want = {i: brute_share(t) for i, t in rows}
    assert len(out) == len(rows)
    assert {i for i, r in out.items() if (r["repeated_share"] or 0) >= 0.3} == {i for i, s in want.items() if s >= 0.3}
    assert all(r["repeated_share"] is None or abs(r["repeated_share"] - want[i]) < 1e-9 for i, r in out.items())
    assert got(repetition.found(df.limit(0))) == set()


def test_rare_repetition(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(30))) for i in range(4000)]
    sampled = spark.createDataFrame(rows, "doc_id bigint, text string").orderBy(F.xxhash64("doc_id"), "doc_id").limit(repetition.SAMPLE_ROWS)
    outside = sorted({i for i, _ in rows} - {r["doc_id"] for r in sampled.collect()})[:2]
    rows = [(i, t + " " + t if i in outside else t) for i, t in rows]  # the only cases, none of them in the sample
    assert got(repetition.found(spark.createDataFrame(rows, "doc_id bigint, text string"))) == {(i,) for i in outside}


def test_no_case_scores_below_the_least(spark):
    """Whatever the trees learned, a document whose upper bound reaches the share is measured; most others are not."""
    rng = np.random.default_rng(4)
    texts = []
    for i in range(1500):
        t = " ".join(WORDS[k] + str(rng.integers(10**6)) for k in rng.integers(len(WORDS), size=40))
        texts.append(t + " " + t[: rng.integers(20, len(t))] if i % 5 == 0 else t)
    x, codes, off = repetition.statistics(pa.array(texts))
    share = repetition.shares(codes, off, np.arange(len(texts)))
    most = x[:, repetition.STATISTICS.index("most")]
    assert (most >= share - 1e-12).all()
    for labels in ((share >= 0.3).astype(float), (rng.random(len(texts)) < 0.3).astype(float), np.zeros(len(texts))):
        forest = repetition.fit_trees(x, labels)
        score, least = forest.score(x), repetition.least_score(forest)
        assert (score[most >= 0.3] >= least).all()
    forest = repetition.fit_trees(x, share >= 0.3)
    assert (forest.score(x) >= repetition.least_score(forest)).mean() < 0.3


def test_every_share(spark):
    rng = random.Random(9)
    rows = [(0, None), (1, ""), (2, "ab"), (3, "。 。")]
    for i in range(4, 900):
        t = " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(60))
        rows.append((i, t + " " + t[: rng.randrange(30, 120)] if i % 4 == 0 else t))
    out = {r["doc_id"]: r["repeated_share"] for r in repetition.measure(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out.pop(0) is None and len(out) == len(rows) - 1
    want = {i: brute_share(t) for i, t in rows[1:]}
    assert sum(0 < s < 0.3 for s in want.values()) > 200
    assert all(s is not None and abs(s - want[i]) < 1e-9 for i, s in out.items())


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=1500) > 0.6).astype(float)
    f = trees.fit(x, y, {0: 1, 1: -1})
    grid = np.repeat(rng.random((20, 3)), 50, axis=0)
    for col, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, col] = np.tile(np.linspace(0, 1, 50), 20)
        assert (sign * np.diff(f.score(g).reshape(20, 50), axis=1) >= -1e-12).all()
    held = rng.random((500, 3))
    assert ((f.score(held) > 0) == (held[:, 0] > 0.6)).mean() > 0.85
    assert trees.fit(np.zeros((0, 3)), np.zeros(0)).score(held).shape == (500,)


def test_nearest_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 64))
    x = np.repeat(centres, 12, axis=0) + 0.15 * rng.normal(size=(360, 64))
    rows = [(i, f"v{i:03}", [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, "v001", rows[1][2]), (901, "n", None), (902, "e", []), (903, "s", [1.0]), (904, "z", [0.0] * 64), (905, "q", [float("nan")] * 64), (906, None, rows[0][2])]
    df = spark.createDataFrame(rows, "vec_no bigint, id string, vector array<float>").repartition(4)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {tuple(sorted((f"v{i:03}", f"v{j:03}"))) for i in range(360) for j in np.argsort(-s[i])[:5]}
    out = got(knn.found(df))
    assert len(out & want) >= 0.95 * len(want)
    monkeypatch.setattr(knn, "BLOCK", 16)  # tiles
    assert len(got(knn.found(df)) & want) >= 0.95 * len(want)
    assert got(knn.found(df.limit(0))) == set()


def test_measured_recall(spark):
    """True neighbours of the sample are those of brute force, and shorter substrings never lose pairs."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 64)), 8, axis=0) + 0.6 * rng.normal(size=(480, 64))
    df = spark.createDataFrame([(i, f"v{i}", [float(v) for v in r]) for i, r in enumerate(x)], "vec_no bigint, id string, vector array<float>").repartition(3)
    q, near = knn.true_neighbours(knn.usable(df).cache(), 5, 50)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.sort(q @ u.T, axis=1)[:, ::-1][:, 1:6]
    assert np.allclose(np.sort((near * q[:, None]).sum(axis=2), axis=1)[:, ::-1], s, atol=1e-6)
    recall = knn.measured_recall(q, near, *knn.fit_rotations(u, 12 * knn.SUBSTRINGS), 12)
    values = [recall[b] for b in sorted(recall)]
    assert values == sorted(values, reverse=True) and values[0] > values[-1]


def test_tiles_lose_no_pair():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20, 64)).astype(np.float32)
    no, own = np.arange(20), np.arange(20) % 2
    q, c, s = knn.best_of_tile(np.zeros(20, int), own, no, v, 19)
    assert {(a, b) for a, b in zip(q, c, strict=True)} == {(a, b) for a in range(20) for b in range(20) if own[a] != own[b]}


def test_mixing(spark):
    rng = random.Random(7)
    docs = [(i, rng.choice(["a", "a", "a", "b", None, "d"]), "word " * rng.randrange(1, 30)) for i in range(600)] + [(700, "a", None), (701, "b", "")]
    targets = [("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.1, 5), ("d", 0.1, 1), (None, 0.2, 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(4)
    t = spark.createDataFrame(targets, "source string, target_weight double, max_repeats bigint")
    m = mixing.mixture(d, t, budget=4000).toPandas()
    assert not m.duplicated(["doc_id", "repeat_no"]).any() and m.n_tokens.sum() <= 4000 and m.n_tokens.sum() > 3900
    share = m.groupby("source").n_tokens.sum() / m.n_tokens.sum()
    assert abs(share["a"] - 0.5 / 0.9) < 0.03 and abs(share["b"] - 0.3 / 0.9) < 0.03 and "c" not in share
    for _, g in m.groupby("source"):
        g = g.sort_values("finish")
        assert np.allclose(g.finish * g.weight, g.n_tokens.cumsum())
    everything = mixing.mixture(d, t, budget=10**9).toPandas()
    assert everything.groupby("source").repeat_no.max().to_dict() == {"a": 2, "b": 1, "d": 0}
    r = {x["source"]: x for x in mixing.shares(spark.createDataFrame(m), t).collect()}
    assert r["c"]["n_docs"] == 0 and abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-9
    assert mixing.mixture(d.limit(0), t).count() == 0 and mixing.mixture(d, t.limit(0)).count() == 0


def test_repeats_that_the_budget_cannot_reach(spark, monkeypatch):
    """Leaving them out changes nothing, for sources of a few tokens as well."""
    rng = random.Random(11)
    docs = [(i, rng.choice("aaaaaaaab"), "word " * rng.randrange(1, 200)) for i in range(200)] + [(900, "c", "three small words"), (901, "c", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("a", 0.3, 40), ("b", 0.4, 3), ("c", 0.3, 900)], "source string, target_weight double, max_repeats bigint")
    for budget in (None, 500, 60_000):
        m = got(mixing.mixture(d, t, budget).select("doc_id", "repeat_no"))
        with monkeypatch.context() as whole:
            whole.setattr(mixing, "needed_repeats", lambda present, budget: present)
            assert m == got(mixing.mixture(d, t, budget).select("doc_id", "repeat_no"))
    sized, present = mixing.sized_sources(d, t)
    assert mixing.needed_repeats(present, 500).agg(F.max("repeats")).first()[0] < 300


def test_running_sum_over_batches(spark):
    rows = [("ab"[i > 700], i, i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, i bigint, v bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for group in (None, "g"):
            order = ["g", "i"] if group else ["i"]
            out = {r["i"]: r["s"] for r in mixing.running_sum(df, order, "v", "s", group).collect()}
            for i in (0, 99, 350, 700, 701, 999):
                assert out[i] == sum(r[2] for r in rows if r[1] <= i and (not group or r[0] == rows[i][0]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@given(st.lists(st.text(alphabet="aÄß9 .时", max_size=60), max_size=6))
def test_kernels(texts):
    import pyarrow as pa

    codes, off = kernels.fold(pa.array([*texts, None], pa.string()))
    folded = ["".join(map(chr, codes[off[i] : off[i + 1]])) for i in range(len(texts) + 1)]
    assert folded == [*map(letters, texts), ""]
    keys = kernels.text_keys(codes, off)
    assert len(set(keys.tolist())) == len(set(folded))
    sets, cuts = kernels.shingle_sets(codes, off, 8)
    assert np.diff(cuts).tolist() == [len({f[j : j + 8] for j in range(len(f) - 7)}) for f in folded]
