from __future__ import annotations

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.functions import text as tx
from lorewell.operators import chunking as ch
from lorewell.sources.files import decode_bytes
from lorewell.sources.knowledge_base import safe_name
from lorewell.sources.pages import paragraph_text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [(None, ""), ("", ""), (" a　 b\t\nc ", "a b c"), ("a\x00b\x1fc\x7f", "abc"), (" x ", "x"), ("x" * 100_000, "x" * 100_000)],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, tx.clean_text) == clean


@pytest.mark.parametrize(("name", "ext"), [("a.TXT", ".txt"), ("d.e/f.v", ".v"), (".v", ""), ("none", ""), ("a.b.sv", ".sv"), ("", "")])
def test_file_extension(spark, name, ext):
    assert one(spark, name, tx.file_extension) == ext


def test_small_functions(spark):
    assert one(spark, "x" * 9000, tx.embed_input) == "x" * 8000
    assert one(spark, "", tx.embed_input) is None
    assert [one(spark, v, tx.not_blank) for v in (None, " 　", "a")] == [False, False, True]
    assert one(spark, " a  b ", tx.sentence) == " a b "
    assert one(spark, " 我的 kb-1 ", tx.kb_name) == "我的_kb_1"
    assert one(spark, "A title - site", tx.result_title) == "A title"
    assert safe_name(" a/../b ") == "a____b"


def test_reasoning(spark):
    get = lambda s: one(spark, s, tx.parse_reasoning).asDict()
    full = get('{"analysis": "a", "missing_info": ["m"], "follow_up_queries": ["q"], "is_sufficient": true}')
    assert full == {"analysis": "a", "missing_info": ["m"], "follow_up_queries": ["q"], "is_sufficient": True}
    assert get("{}") == {"analysis": "", "missing_info": [], "follow_up_queries": [], "is_sufficient": False}
    for bad in ("no json", None, "[1]"):
        assert get(bad)["missing_info"] == ["无法识别缺失信息"]


def brute_pack(text: str, size: int, overlap: int) -> list[str]:
    step = size - overlap
    out, i = [], 0
    while True:
        out.append(text[i : i + size].strip())
        if i + size >= len(text):
            return [c for c in out if c]
        i += step


@given(st.text(alphabet="ab c", max_size=300), st.integers(5, 40))
def test_windows_agree_with_recursion(text, size):
    assert ch.windows(text, size, 3) == (ch.split_recursive(text, [""], size, 3) if text else [])


@given(st.text(alphabet="ab。，; \n", max_size=400), st.integers(10, 60))
def test_recursive_split_keeps_limit_and_text(text, size):
    for profile in ch.PROFILES.values():
        chunks = ch.split_recursive(text, profile, size, 4)
        assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
        assert set("".join(chunks)) >= set(re.sub(r"\s", "", text)) - {""}


def test_profiles(spark):
    code = "module a; " + "x" * 30 + " endmodule module b; " + "y" * 30 + " endmodule"
    chunks = ch.split_text(code, ".V", 60, 5)
    assert chunks[1].startswith("endmodule")
    rows = spark.createDataFrame([(code, ".v"), (None, ".v"), ("", None), ("短", ".pdf")], "t string, e string")
    got = [r[0] for r in rows.select(ch.semantic_chunks(F.col("t"), F.col("e"), 60, 5)).collect()]
    assert got[0] == chunks and got[1:] == [[], [], []]


def brute_segments(text, longest, seps):
    text = text.strip()
    if not seps or len(text) <= longest:
        return [text]
    out, cur = [], ""
    parts = text.split(seps[0])
    for i, p in enumerate(parts):
        if cur and p and len(cur) + len(p) > longest - 1:
            out.extend(brute_segments(cur, longest, seps[1:]))
            cur = ""
        cur += p if i == len(parts) - 1 else p + seps[0]
    return out + (brute_segments(cur, longest, seps[1:]) if cur else [])


@given(st.text(alphabet="ab。\n ", max_size=200), st.integers(3, 40))
def test_segments(text, longest):
    assert ch.segments(text, longest) == brute_segments(text, longest, "\n。")


def test_decode_and_html():
    assert decode_bytes("时钟".encode("gbk")) == "时钟"
    assert decode_bytes("é".encode()) == "é" and decode_bytes(b"\xff\xff") == "ÿÿ" and decode_bytes(None) is None
    html = "<div>no</div><p>one &amp; <b>bold</b> two<p>three<br>four</p><script>x</script>"
    assert paragraph_text(html) == "one & \n two\nthree\nfour"
    assert paragraph_text(None) == "" and paragraph_text("<p></p>") == ""
