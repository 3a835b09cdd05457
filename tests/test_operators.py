from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.config import Settings
from lorewell.functions import vector as vx
from lorewell.operators import chunking, embed, merge, multihop, prompts, recall
from lorewell.operators import search as vs
from lorewell.operators.dialogue import Dialogue
from lorewell.plans.ingest import ingest_files
from lorewell.plans.session import cut
from lorewell.sources import store
from lorewell.sources.files import DETECTED_ENCODINGS, decode_bytes, decode_detected, read_files
from lorewell.sources.knowledge_base import KnowledgeBases
from lorewell.sources.pages import TableProvider, result_links
from lorewell.streaming.ingest import stream_ingest


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_upsert_keeps_place_and_takes_last_value(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None), (None, 4, "z")], "id string, pos bigint, v string")
    assert rows(merge.upsert(df, "id", "pos")) == [("a", 1, None), ("b", 2, "y")]
    assert rows(merge.upsert(df.limit(0), "id", "pos")) == []


def test_keep_first_and_scores(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z")], "k string, o bigint, v string")
    assert rows(merge.keep_first(df, ["k"], "o"), "o") == [("a", 1, "y"), (None, 3, "z")]
    s = spark.createDataFrame([(0.5, 1), (0.5, 2), (0.1, 3)], "score double, n bigint")
    assert rows(merge.collapse_scores(s, "score", "n")) == [(0.1, 3), (0.5, 2)]


@pytest.mark.parametrize("metric", vs.METRICS)
def test_search_is_exact(spark, metric, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, size=(60, 4)).astype(float)
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None), (98, []), (97, [float("nan")] * 4)]
    df = spark.createDataFrame(data, "pos bigint, vector array<double>").repartition(5)
    q = df.where("pos % 7 = 0 AND pos < 60").withColumnRenamed("pos", "qid")
    got = rows(vs.search(q, df, 3, metric).select("qid", "rk", "pos"))
    for qid, rk, pos in got:
        s = np.round(vs.scores(x[qid : qid + 1], x, metric)[0], 6) + 0.0
        assert pos == sorted(range(60), key=lambda i: (-s[i], i))[rk - 1]
    assert len(got) == 9 * 3
    assert rows(vs.search(q, df.limit(0), 3, metric)) == []


def test_padding_and_plan(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "pos bigint, vector array<double>")
    hits = vs.search(df.where("pos = 0").withColumnRenamed("pos", "qid"), df, 5)
    assert rows(vs.pad_hits(hits, df, 5).select("rk", "pos")) == [(1, 0), (2, 1), (3, 1), (4, 1), (5, 1)]
    plan = lambda n: tuple(vs.index_plan(spark.range(n).select(F.array(F.lit(1.0)).alias("vector"))).first())
    assert plan(38) == (38, 1, "flat", "ip") and plan(39) == (39, 1, "ivf", "l2") and plan(500)[1] == 12 and plan(9999)[1] == 128


def test_cells(spark):
    data = [(i, [float(i % 3) * 10 + 1, float(i)]) for i in range(30)]
    df = spark.createDataFrame(data, "pos bigint, vector array<double>")
    cents = [(0, [1.0, 0.0]), (1, [11.0, 0.0]), (2, [21.0, 0.0])]
    c = vs.assign_cells(df, cents, metric="l2")
    assert all(r["cell"] == r["pos"] % 3 for r in c.collect())
    near = rows(vs.search_cells(c.where("pos = 4").withColumnRenamed("pos", "qid"), c, 3).select("rk", "pos"))
    assert near == [(1, 4), (2, 1), (3, 7)]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "a array<double>, b array<double>, t array<array<double>>, m array<int>")
    r = df.select(vx.dot(F.col("a"), F.col("b")), vx.norm(F.col("a")), vx.cosine(F.col("a"), F.col("b")), vx.squared_distance(F.col("a"), F.col("b")), vx.l2_normalise(F.col("a")), vx.mean_pool(F.col("t"), F.col("m"))).first()
    assert r[0] == 24 and r[1] == 5 and abs(r[2] - 0.96) < 1e-12 and r[3] == 2 and r[4] == [0.6, 0.8] and r[5] == [2.0, 3.0]


def test_embedding_is_row_aligned(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "abc")], "pos bigint, text string")
    got = {r["pos"]: r["vector"] for r in embed.embed_column(df, "text", embed.HashEmbedder(8)).collect()}
    assert got[1] == got[4] and got[2] is None and got[3] is None
    have = spark.createDataFrame([("a", [1.0])], "id string, vector array<double>")
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, chunk string")
    assert [r["id"] for r in embed.embed_missing(chunks, have, embed.HashEmbedder(8)).collect()] == ["b"]


def test_recall(spark):
    s = Settings(top_titles=1, top_sentences=2, min_sentence=5, segment_length=20)
    pages = spark.createDataFrame([(1, "fifo notes", "first sentence one\nsecond sentence\nfirst sentence one"), (2, "other", "nothing here at all"), (3, None, None)], "pos bigint, title string, text string")
    kw = recall.scaled_keywords([("fifo", 2.0), ("x", 1.0)])
    assert abs(sum(w for _, w in kw) - 2) < 1e-3 and recall.scaled_keywords([]) == []
    assert recall.recall_by_keywords(pages, kw, s).first()[0] == "first sentence one\nsecond sentence"
    count = spark.createDataFrame([("fifo fifo",)], "t string").select(recall.sentence_score(F.col("t"), kw, "count")).first()[0]
    assert abs(count - 2 * kw[0][1]) < 1e-9
    assert "sentence" in recall.recall_by_vectors(pages, "fifo notes", embed.HashEmbedder(), s).first()[0]


def test_prompts(spark):
    hits = spark.createDataFrame([(1, k, f"c{k}") for k in range(1, 13)], "qid bigint, rk int, chunk string")
    assert prompts.contexts(hits.where("rk < 3"), ["qid"]).first()["context"] == "[Chunk 1]: c1\n\n[Chunk 2]: c2"
    r = prompts.summary(hits, ["qid"]).first()
    assert r["n_more"] == 2 and r["summary"].count("检索块") == 10
    turns = spark.createDataFrame([(1, t, f"q{t}", f"a{t}") for t in range(5)], "conv_id bigint, turn bigint, user_text string, assistant_text string")
    h = prompts.history_prompt(turns).first()["history"]
    assert "q1" not in h and h.index("q2") < h.index("q4")
    got = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "w boolean, l boolean").select(prompts.route(F.col("w"), F.col("l")))
    assert [r[0] for r in got.collect()] == ["merge", "web", "local", "none"]


def test_multihop_stops(spark):
    calls = []

    def search(q, k):
        calls.append(k)
        return q.select("qid", "fid", (F.col("payload") * 10).alias("item"), F.lit(1).alias("rk"))

    def follow(hits):
        return hits.select("qid", F.when(F.col("item") < 1000, F.array("item")).otherwise(F.array().cast("array<bigint>")).alias("follow_ups"))

    q = spark.createDataFrame([(1, 1), (2, 50)], "qid bigint, payload bigint")
    out = multihop.multihop(q, search, multihop.ScriptedReasoner(follow), Settings(), cut)
    assert rows(out.select("qid", "item", "hop")) == [(1, 10, 0), (1, 100, 1), (1, 1000, 2), (2, 500, 0), (2, 5000, 1)]
    assert calls == [5, 3, 3]
    calls.clear()
    multihop.multihop(q, search, multihop.ScriptedReasoner(follow, enough_at=0), Settings(), cut)
    assert calls == [5]
    hits = spark.createDataFrame([(1, 1, "c")], "qid bigint, rk int, chunk string")
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "qid bigint, question string")
    a = {r["qid"]: r["answer"] for r in multihop.answer(asked, hits, multihop.TemplateGenerator(), True).collect()}
    assert "[Chunk 1]: c" in a[1] and a[2] == "未找到相关信息。"


def test_batches(spark):
    assert rows(chunking.batch_plan(spark.range(23), 10)) == [(0, 10), (1, 10), (2, 3)]
    assert rows(chunking.batch_plan(spark.range(0), 10)) == []


def test_results(spark):
    p = spark.createDataFrame([(2, "http://a", "T - s", "x", "q"), (1, "http://a", "U", "y", "q"), (3, "http://doc.b", "V", "z", "q"), (4, None, "W", "w", "q")], "page_id bigint, url string, title string, text string, query_text string")
    assert rows(result_links(TableProvider(p).search("q")).select("pos", "title")) == [(1, "U")]


def test_knowledge_base_and_stream(spark, tmp_path):
    kb = KnowledgeBases(spark, f"file://{tmp_path}/kb")
    assert kb.list() == ["default"]
    assert kb.create("my kb") == "my_kb"
    with pytest.raises(FileExistsError):
        kb.create("my kb")
    for bad, error in (("default", PermissionError), ("../x", ValueError), ("gone", FileNotFoundError)):
        with pytest.raises(error):
            kb.drop(bad)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("text of the first file; " * 5)
    (folder / "b.v").write_bytes("模块说明和更多的内容，写到二十个字以上才行的样子".encode("gbk"))
    (folder / "c.pdf").write_bytes(b"%PDF")
    got = {r["source"]: r for r in read_files(spark, str(folder)).collect()}
    assert got["c.pdf"]["error"] and got["b.v"]["text"].startswith("模块")
    (folder / "c.pdf").unlink()
    for _ in range(2):
        stream_ingest(spark, str(folder), kb, "my_kb", str(tmp_path / "cp")).awaitTermination()
    assert rows(kb.files("my_kb")) == [("a.txt",), ("b.v",)]
    n = kb.chunks("my_kb").count()
    (folder / "a.txt").write_text("x")
    kb.merge("my_kb", kb.chunks("my_kb").select("pos", "id", "chunk", "source", "method"))
    assert kb.chunks("my_kb").count() == n
    kb.drop("my_kb")
    assert kb.list() == ["default"]


def test_reasoning_and_parallel_prompts(spark):
    asked = spark.createDataFrame([(1, "why"), (2, "how")], "qid bigint, question string")
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "qid bigint, chunk string, rk int")
    steps = spark.createDataFrame(
        [(1, 1, "second", None, []), (1, 0, "first", ["m", "n"], ["q1", "q2"])], "qid bigint, step int, analysis string, missing_info array<string>, follow_up_queries array<string>"
    )
    out = {r["qid"]: r["prompt"] for r in multihop.synthesis_prompt(asked, hits, True, steps).collect()}
    trace = "\n\n推理步骤 1:\n分析: first\n缺失信息: m, n\n后续查询: q1, q2\n\n推理步骤 2:\n分析: second\n缺失信息: \n后续查询: "
    assert f"[Chunk 2]: b\n\n## 推理过程\n{trace}\n\n请尽可能" in out[1] and "推理步骤" not in out[2]
    df = spark.createDataFrame([(["a", "b"], "ctx", "w", "l"), ([], "", "w", ""), (None, None, None, "l"), (None, None, "", None)], "p array<string>, c string, w string, l string")
    cols = [prompts.reasoning_prompt(F.lit("why"), F.col("p"), F.col("c"), F.lit(1)).alias("r"), prompts.parallel_prompt(F.lit("why"), F.col("w"), F.col("l")).alias("m"), prompts.parallel_answer(F.lit(None).cast("string"), F.col("l")).alias("a")]
    rows = df.select(*cols).collect()
    assert "先前查询（如果有）\nQ1: a\nQ2: b\n" in rows[0]["r"] and "（跳数 1）\nctx\n" in rows[0]["r"] and "is_sufficient" in rows[0]["r"]
    assert all("（如果有）\n无\n" in r["r"] and "未检索到信息。" in r["r"] for r in rows[1:])
    assert rows[0]["m"].startswith("问题：why\n\n网络搜索结果：w\n\n本地知识库分析：l") and rows[1]["m"].endswith("[联网搜索结果]：w") and rows[2]["m"] is None and rows[3]["m"] is None
    assert [r["a"] for r in rows] == ["l", "未找到相关信息。", "l", "未找到相关信息。"]


def test_search_over_a_grid(spark, monkeypatch):
    """Beyond the broadcast limit, blocks are spread over a grid; cells, widths and hits stay the same."""
    rng = np.random.default_rng(3)
    data = [(i, i % 4, [float(v) for v in rng.normal(size=3 + i % 2)]) for i in range(200)]
    df = spark.createDataFrame(data, "pos bigint, cell bigint, vector array<double>").repartition(6)
    q = df.where("pos % 9 = 0").withColumnRenamed("pos", "qid")
    want = rows(vs.search(q, df, 3, "l2", cell="cell"))
    assert all(data[r[0]][1] == data[r[1]][1] and len(data[r[0]][2]) == len(data[r[1]][2]) for r in want)
    monkeypatch.setattr(vs, "BROADCAST_BYTES", 300)
    monkeypatch.setattr(vs, "BLOCK", 7)
    assert rows(vs.search(q, df, 3, "l2", cell="cell")) == want
    two = q.withColumn("n", F.lit(5))
    assert rows(vs.search(two, df, 3, "l2", q_key=["qid", "n"], cell="cell").drop("n")) == want


def test_embedders():
    tries = []

    def call(texts):
        tries.append(len(texts))
        if len(tries) == 1:
            raise OSError("busy")
        return [[float(len(t)), 1.0] for t in texts]

    api = embed.ApiEmbedder(call, 2, batch=2, wait=0)
    assert api.embed(["a", "bb", "ccc"]).tolist() == [[1, 1], [2, 1], [3, 1]] and tries == [2, 2, 1]
    assert api.embed([]).shape == (0, 2)
    with pytest.raises(ValueError):
        embed.ApiEmbedder(lambda t: [[1.0]], 2, wait=0).embed(["a"])
    loads = []

    def load():
        loads.append(1)
        return (lambda t: (np.zeros((len(t), 3)), [[1, 1, 0]] * len(t))), (lambda ids, mask: np.arange(6.0).reshape(1, 3, 2).repeat(len(ids), 0))

    model = embed.ModelEmbedder(load, 2)
    assert model.embed(["x"]).tolist() == [[1.0, 2.0]] and model.embed(["y", "z"]).shape == (2, 2) and loads == [1]
    assert embed.LetterEmbedder().embed(["Abba é"]).tolist()[0][:3] == [2, 2, 0]


def test_decoding_with_detection():
    chinese = "时钟信号在复位之后有效"
    assert decode_detected(chinese.encode("gbk")) == chinese and decode_detected(("﻿" + chinese).encode("utf-16-le")) == chinese
    assert decode_detected(b"") == "" and decode_detected(None) is None and decode_detected(b"abc\xff\xfe") == decode_bytes(b"abc\xff\xfe", DETECTED_ENCODINGS)

    class Sure:
        def detect(self, raw):
            return "ascii", 0.9

    assert decode_detected("é!".encode(), Sure()) == "é!" and decode_detected(b"\xff!", Sure()) == "!"


def test_store_leaves_old_or_new(spark, tmp_path, monkeypatch):
    """An upsert that fails anywhere leaves the table as it was; only buckets of the batch are rewritten."""
    path = f"file://{tmp_path}/t"
    open_ = lambda: store.BucketStore(spark, path, "pos bigint, id string, v int", buckets=4)
    df = lambda *r: spark.createDataFrame(list(r), "pos bigint, id string, v int")
    assert open_().merge(df((0, "a", 1), (1, "b", 2), (2, "a", 3), (3, None, 9))) == (2, 3)
    before = rows(open_().read(), "id")
    assert before == [(0, "a", 3), (1, "b", 2)]
    monkeypatch.setattr(store, "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        open_().merge(df((0, "a", 7)))
    assert rows(open_().read(), "id") == before
    monkeypatch.undo()
    kept = open_()._state()["folders"]
    assert open_().merge(df((0, "b", 5), (1, "c", 6)))[0] == 3
    assert rows(open_().read(), "id") == [(0, "a", 3), (1, "b", 5), (4, "c", 6)]
    now = open_()._state()["folders"]
    assert any(now.get(b) == f for b, f in kept.items())
    assert open_().merge(df((0, "z", 1)), open_().read().where("id = 'a'"))[0] == 2
    assert open_().merge(df())[0] == 2


def test_upload_and_dialogue(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("the counter waits for the reset of the bridge and starts again")
    (folder / "b.txt").write_text("zebra quagga okapi giraffe and more animals of the plain")
    (folder / "c.pdf").write_bytes(b"%PDF")
    (folder / "d.txt").write_text("short")
    bases = KnowledgeBases(spark, f"file://{tmp_path}/kb")
    with pytest.raises(ValueError):
        ingest_files(bases, " ", str(folder), embed.LetterEmbedder())
    report = ingest_files(bases, "notes", str(folder), embed.LetterEmbedder())
    assert (report.total, report.new, report.n_errors) == (2, 2, 2) and {r["source"] for r in report.errors.collect()} == {"c.pdf", "d.txt"}
    assert "总条目: 2\n本次新增: 2" in report.message
    assert ingest_files(bases, "notes", str(folder), embed.LetterEmbedder()).total == 2
    v = {r["id"]: r["pos"] for r in bases.vectors("notes").collect()}
    assert v == {r["id"]: r["pos"] for r in bases.chunks("notes").collect()} and len(v) == 2
    # replaced files lose their old chunks, and the vectors of these go
    new = spark.createDataFrame([(0, "n", "quagga quagga zebra zebra", "b.txt", "m")], "pos bigint, id string, chunk string, source string, method string")
    assert bases.merge("notes", new, replace_sources=True)[0] == 2 and bases.embed("notes", embed.LetterEmbedder()) == 2
    asked = spark.createDataFrame([(1, "zebra"), (2, " "), (3, None)], "qid bigint, question string")
    hits = rows(bases.search("notes", asked, embed.LetterEmbedder(), 1, "cosine").select("qid", "rk", "id"))
    assert hits == [(1, 1, "n")]

    class Echo:
        def generate(self, p):
            return p.withColumn("answer", F.concat(F.lit("A:"), F.col("prompt")))

    class Broken:
        def search(self, query):
            raise OSError("no network")

    pages = spark.createDataFrame([(1, "http://a", "T", "web words", "zebra")], "page_id bigint, url string, title string, text string, query_text string")
    talk = lambda provider, kb="notes", **k: Dialogue(bases, kb, embed.LetterEmbedder(), Echo(), provider, **k)
    events = list(talk(TableProvider(pages)).stream("zebra", [("old question", "old answer")]))
    assert [e.stage for e in events] == ["start", "hits", "local", "web", "merge"]
    assert "用户：old question\n助手：old answer\n" in events[-1].answer and "网络搜索结果：web words" in events[-1].answer and "[Chunk 1]" in events[2].answer
    events = list(talk(Broken()).stream("zebra"))
    assert [e.stage for e in events] == ["start", "hits", "local", "web failed", "web", "local"] and events[-1].answer == events[2].answer
    assert list(talk(None, "gone").stream("zebra"))[-1].answer.startswith("无法回答")
    assert [e.stage for e in talk(TableProvider(pages), "gone").stream("zebra")] == ["start", "web", "web"]
    reasoner = multihop.ScriptedReasoner(lambda h: h.where("rk = 1").select("qid", F.array("chunk").alias("follow_ups")), enough_at=1)
    events = list(talk(None, reasoner=reasoner).stream("zebra", multi_hop=True))
    assert [e.stage for e in events] == ["start", "hop 0", "hop 1", "local", "local"] and "quagga" in events[-1].answer


def test_older_profiles():
    text = "一二三四五六，七八九十。" * 3
    new, old = (chunking.split_text(text, ".pdf", 12, 0, 1, p) for p in (chunking.PROFILES, chunking.OLDER_PROFILES))
    assert new == old  # the full stop comes first in both
    text = "a;b c;d e;f g"
    assert chunking.split_text(text, ".txt", 5, 0, 1) == ["a;b c", ";d e", ";f g"]
    assert chunking.split_text(text, ".txt", 5, 0, 1, chunking.OLDER_PROFILES) == ["a;b", "c;d", "e;f", "g"]
    text = "一，二！三，四！五，六"
    assert chunking.split_text(text, ".pdf", 4, 0, 1) == ["一，二", "！三，四", "！五，六"]
    assert chunking.split_text(text, ".pdf", 4, 0, 1, chunking.OLDER_PROFILES) == ["一", "，二！三", "，四！五", "，六"]
