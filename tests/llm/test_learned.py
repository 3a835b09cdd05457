"""Problems 1 and 2: held-out accuracy, exact round trips, gradients, and odd rows."""

from __future__ import annotations

import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lorewell.llm import boilerplate as bp
from lorewell.llm import frames
from lorewell.llm import mojibake as mo
from lorewell.llm.common import hashed_sample
from lorewell.llm.lstm import Labeller

SOUND = "Überlauf Zähler für Größe décalage mémoire arrêt réglé naïve 时钟信号在复位之后有效 读指针与写指针 “quoted” 5 µs ±3 °C ½ Émetteur déjà prêt après Prüfung höchstens schließt 寄存器映射表说明".split()


@pytest.mark.parametrize("chain", list(mo.CHAINS))
def test_round_trip(chain):
    n = 0
    for t in SOUND:
        g = mo.garble(t, chain)
        if g is None or "�" in g:
            continue
        back = mo.invert(g, chain)
        assert back in (t, None)
        n += back == t
    assert n or chain in ("gbk as utf-8", "cp1252 as utf-8", "utf-8 as big5", "cp1252 as cp437", "cp1252 as mac-roman", "cp1252 as cp1251", "cp1252 as gbk", "utf-8 as cp932", "utf-8 as gbk", "utf-8 as gb18030")


def test_sound_text_survives():
    for t in ("ATENÇÃO,", "NÃO", "Âge", "ÂME", "Ã,", "É,", "ß,", "сигнал", "信号wr_sync77をリセットする。", "flip–flops", "µs"):
        assert not any(mo.invert(t, c) for c in mo.CHAINS if c.startswith(("utf-8", "twice"))), t


def test_repair(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        words = [SOUND[k] + str(rng.integers(99)) for k in rng.integers(len(SOUND), size=12)]
        text = " plain ".join(words)
        rows.append((i, text, f"Titel für {words[0]}", False))
    bad = set()
    clean = {r[0]: r[1] for r in rows}
    chains = ["utf-8 as cp1252", "utf-8 as latin-1", "utf-8 as cp437", "utf-8 as mac-roman", "twice utf-8 as latin-1"]
    for i in range(0, 300, 10):
        t = " ".join(mo.garble(w, chains[i // 10 % len(chains)]) or w if k % 2 else w for k, w in enumerate(rows[i][1].split(" ")))
        if t != rows[i][1]:
            bad.add(i)
        rows[i] = (i, t, rows[i][2], True)
    rows += [(900, None, None, False), (901, "", "", False), (902, "ascii only", "x", False)]
    df = spark.createDataFrame(rows, "page_id bigint, text string, title string, field boolean")
    out = {(r["page_id"], r["field"]): r for r in mo.repair(df).collect()}
    hit = {p for p, f in out if f == "text"}
    assert len(hit & bad) >= 0.95 * len(bad) and len(hit - bad) <= 3
    good = [p for p in hit & bad if out[p, "text"]["restored"] == clean[p]]
    assert len(good) >= 0.9 * len(hit & bad)
    assert mo.found(df.limit(0)).count() == 0


def test_found_fields_do_not_depend_on_the_draw():
    """Ten draws of the sample report the same fields, up to 2 %, and leave sound words alone."""
    at = Path("/root/testdata/sf0.1/web_results.parquet")
    if not at.exists():
        pytest.skip("no test data here")
    rows = pq.read_table(at, columns=["text", "title"]).to_pylist()
    tokens = defaultdict(set)
    for i, r in enumerate(rows):
        for f in ("text", "title"):
            for t in mo.tokens_of(r[f]):
                tokens[t].add((i, f))
    counts = []
    for draw in range(10):
        rng = np.random.default_rng(draw)
        part = rng.choice(len(rows), 1500, replace=False)
        bad = mo.judge(list(tokens), mo.train([t for i in part for f in ("text", "title") for t in mo.tokens_of(rows[i][f])]))
        assert not {"öffnet", "öffnet.", "à", "für", "é,"} & set(bad)
        counts.append(len(set().union(*(tokens[t] for t in bad))))
    assert max(counts) - min(counts) <= 0.02 * max(counts), counts


def test_hashed_sample(spark):
    df = spark.range(5000).selectExpr("id", "id AS x")
    got = hashed_sample(df, "id", 300).collect()
    assert len({r["id"] for r in got}) == 300 and hashed_sample(df.limit(7), "id", 300).count() == 7 and hashed_sample(df.limit(0), "id", 3).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    m = Labeller(50, 4, bp.SHAPE, 3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    b, _ = bp.make_batch(bp.read_lines(pa.array(["one two\nthree: four\nx", "five"])), np.arange(2))
    b.ids = b.ids % 50
    y = rng.integers(0, 2, b.shapes.shape[:2]).astype(float)
    w = np.ones_like(y)
    _, g = m.gradients(b, y, w)
    for key in ("Wf", "Ub", "bf", "v", "c", "E"):
        flat = m.p[key].reshape(-1)
        for at in rng.integers(len(flat), size=4):
            if key == "E":
                at = b.ids[at % len(b.ids)] * 4 + at % 4
            old = flat[at]
            flat[at] = old + 1e-3
            up = m.gradients(b, y, w)[0]
            flat[at] = old - 1e-3
            down = m.gradients(b, y, w)[0]
            flat[at] = old
            assert abs((up - down) / 2e-3 - g[key].reshape(-1)[at]) < 2e-3


BODY = "The counter named {0} drives {1} entries before the reset, so the buffer waits. Set it to {1} first."
FRAME = ["Home | Products | Contact", "We use cookies to improve your visit.", "Share this: Mail | Print", "© 2021 Maker. All rights reserved."]


def made_pages(n, seed):
    rng = np.random.default_rng(seed)
    rows, truth = [], set()
    for i in range(n):
        body = [BODY.format("sig_" + str(rng.integers(10**6)), rng.integers(999)) for _ in range(rng.integers(3, 9))]
        titles = [f"{a} {b} notes" for a, b in zip(rng.choice(SOUND, 3), rng.choice(SOUND, 3), strict=True)]
        body.insert(int(rng.integers(1, len(body))), titles[0])
        tail = (["Related articles", *titles[1:]] if rng.random() < 0.5 else []) + [FRAME[2], FRAME[3]]
        lines = [*((x, 1) for x in FRAME[: int(rng.integers(1, 3))]), *((x, 0) for x in body), ("", None), *((x, 1) for x in tail)]
        rows.append((i, "\n".join(x for x, _ in lines), "u"))
        truth |= {(i, k) for k, (_, y) in enumerate(lines) if y}
    return rows, truth


def test_labeller(spark):
    rows, truth = made_pages(260, 1)
    rows += [(900, None, "u"), (901, "", None), (902, "\n \n", "u"), (903, "x" * 50_000, "u")]
    df = spark.createDataFrame(rows, "page_id bigint, text string, url string")
    model = bp.fit(df.where("page_id < 200"))
    out = {(r["page_id"], r["line_no"]) for r in bp.label(df, model).selectExpr("page_id", "explode(frame_lines) line_no").collect()}
    held = {t for t in truth if t[0] >= 200}
    mine = {t for t in out if 200 <= t[0] < 900}
    assert len(held & mine) >= 0.97 * len(held) and len(mine - held) <= 0.03 * len(held)
    bodies = {r["page_id"]: r["body"] for r in bp.label(df, model, keep=("url",)).collect()}
    assert bodies[900] == "" and bodies[901] == "" and len(bodies) == len(rows)
    assert bp.label(df.limit(0), model).count() == 0


def test_lines_by_arrays():
    """Numbers, words and shapes of lines, against reading them one by one."""
    texts = ["Hello  world foo_bar12 12,5\n\n 时钟A1 x\n", "", None, "\r\n\x85\nLike (51) Share…", "like (7) share…", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16") + " 𠀀x"]
    got = bp.read_lines(pa.array(texts))
    want = [(p, i) for p, t in enumerate(texts) for i, line in enumerate((t or "").split("\n")) if line.strip()]
    assert list(zip(got.page, got.number, strict=True)) == want
    ids = [sorted(x) for x in np.split(got.ids, got.starts[1:])]
    assert ids[2] == ids[3] and ids[0] != ids[1]  # case and digits do not matter
    words = [6, 5, 6, 6, 3]  # an identifier is one word; a mark, a Chinese character, a run of digits are words
    assert [(len(x) - 1) // 2 for x in ids] == words
    assert got.shapes[1][19] == 1 and got.shapes[2][11] == 1 and got.shapes[0][1] == pytest.approx(np.log1p(4) / 4)
    for odd in ([], [""], [None], ["\n\n"], ["  \t "]):
        assert len(bp.read_lines(pa.array(odd, pa.string())).page) == 0


NOTE = "The information on this website is provided as is, without warranty of any kind; Maker Works is not liable for damage that results from its use, and all product names belong to their owners."


def test_labels_by_recurrence():
    rng = np.random.default_rng(2)
    text = lambda: f"The {' '.join(rng.choice(SOUND, 5))} of s_{rng.integers(10**6)} waits {rng.integers(99)} cycles."
    name = lambda: f"{SOUND[rng.integers(len(SOUND))]} and {SOUND[rng.integers(len(SOUND))]} {chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))} notes"
    pages, labels = [], []
    for i in range(60):
        top = [("Home | Products", 1), (f"Products > {name()}", 1)] if i % 2 else [("Products | Home", 1)]
        code = [(f"module m_{i} (", 0), ("input clk, input rst,", 0), (f"output q_{i});", 0)]
        ad = [("Advertisement", 1), (f"Like ({rng.integers(99)}) Share", 1)] if i % 3 == 0 else []
        other = [("Recent posts", 1), (name(), 1), (name(), 1), (name(), 1)] if i % 4 == 0 else []
        lines = [*top, (name(), 0), (text(), 0), *code, (text(), 0), *ad, (text(), 0), *other, (NOTE, 1), (f"Page {i} of 70", 1)]
        pages.append([x for x, _ in lines])
        labels.append([y for _, y in lines])
    got = [(a, b) for y, z in zip(frames.label_pages(pages), labels, strict=True) for a, b in zip(y, z, strict=True)]
    sure = [(a, b) for a, b in got if a != frames.UNSURE]
    assert len(sure) >= 0.97 * len(got) and sum(a != b for a, b in sure) <= 0.01 * len(sure)
    assert frames.label_pages([]) == [] and frames.label_pages([["one line"]]) == [[0]]


def test_wordings_never_named():
    """Advertising, newsletter and notice lines are learned without a word of them being given: at least 0.8 of each on pages not trained on."""
    at = Path("/root/testdata/sf0.1/web_results.parquet")
    if not at.exists():
        pytest.skip("no test data here")
    rows = [t for t in pq.read_table(at, columns=["text"]).column("text").to_pylist() if t]
    model = Labeller(bp.WORDS, bp.WIDTH, bp.SHAPE, bp.HIDDEN)
    model.fit(bp._batches(*bp.training_pages(rows[:1600])), 4)
    lines, is_frame = bp.frame_lines(pa.array(rows[1600:3600]), model)
    text = [t for r in rows[1600:3600] for t in bp.non_blank(r)]
    for words in ("^Advertisement|^Sponsored:|^Limited offer|^Skip ad|^Anzeige$|^Gesponsert|^Publicité", "newsletter|inbox|weekly digest|^Abonnez-vous|订阅我们", "cookies|vos données|Ihre Daten"):
        hit = [bool(re.search(words, t)) and "_" not in t for t in text]
        assert sum(hit) > 50 and is_frame[hit].mean() >= 0.8, words
    named = np.array(["_" in t and "…" not in t for t in text])
    assert is_frame[named].mean() < 0.03
