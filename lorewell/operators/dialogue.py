"""One question answered step by step: history, web results and a knowledge base, as a stream of (display, answer)."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.config import Settings
from lorewell.functions.text import preview, web_background
from lorewell.plans.session import cut
from lorewell.sources.knowledge_base import KnowledgeBases
from lorewell.sources.pages import SearchProvider

from .embed import Embedder
from .multihop import Generator, Reasoner, answer, hop_events, synthesis_prompt
from .prompts import contexts, enhanced_question, history_prompt, parallel_prompt, route

# What stands for a missing part, and the answers without any source.
NO_WEB, NO_HITS, NOTHING = "未找到相关网络信息", "未找到相关信息。", "无法回答您的问题。请先上传文件到该知识库或启用联网搜索。"


@dataclass(frozen=True)
class Event:
    """A stage of an answer: its name, what to show, and the answer so far."""

    stage: str
    display: str
    answer: str


class Dialogue:
    """Answers questions over a knowledge base and, where a provider is given, the web.

    The web is searched for the bare question beside the local retrieval; the knowledge base is
    searched for the question with its history. A part that fails is shown and the others go on.
    """

    def __init__(self, bases: KnowledgeBases, kb: str, embedder: Embedder, generator: Generator, provider: SearchProvider | None = None, reasoner: Reasoner | None = None, settings: Settings = Settings()):
        self.bases, self.kb, self.embedder, self.generator, self.provider, self.reasoner, self.settings = bases, kb, embedder, generator, provider, reasoner, settings
        self.spark = bases.spark

    def _web(self, question: str) -> str:
        """The background of the first results, joined; bounded by the settings."""
        pages = self.provider.search(question).orderBy("pos").limit(self.settings.top_k)
        texts = [r[0] for r in pages.select(web_background(F.col("text"), self.settings.background_cap)).collect()]
        return "\n".join(t for t in texts if t)[: self.settings.background_cap]

    def _ask(self, text: str, history: list[tuple[str, str]]) -> str:
        turns = self.spark.createDataFrame([(0, i, u, a) for i, (u, a) in enumerate(history)], "conv_id bigint, turn bigint, user_text string, assistant_text string")
        asked = self.spark.createDataFrame([(0, text)], "conv_id bigint, question string")
        told = history_prompt(turns, self.settings.history_turns)
        return asked.join(told, "conv_id", "left").select(enhanced_question(F.col("question"), F.col("history"))).first()[0]

    def _write(self, prompts: DataFrame) -> str:
        row = self.generator.generate(prompts).select("answer").first()
        return row[0] if row else ""

    def _question(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "qid bigint, question string")

    def _simple(self, asked: str) -> Iterator[Event]:
        hits = cut(self.bases.search(self.kb, self._question(asked), self.embedder, self.settings.top_k))
        shown = [r[0] for r in hits.where("rk <= 3").orderBy("rk").select(preview(F.col("chunk"), 100)).collect()]
        yield Event("hits", "\n".join(f"- {s}" for s in shown) or NO_HITS, "")
        details = contexts(hits, ["qid"], layout="bold").first()
        text = answer(self._question(asked), hits, self.generator).first()["answer"]
        yield Event("local", details["context"] if details else NO_HITS, text)

    def _hops(self, asked: str) -> Iterator[Event]:
        def search(queries: DataFrame, k: int) -> DataFrame:
            # few questions: the open follow-ups of one question
            parts = [(r["fid"], r["payload"]) for r in queries.select("fid", "payload").collect()]
            flat = self.spark.createDataFrame([(int(f), str(p)) for f, p in parts], "qid bigint, question string")
            found = self.bases.search(self.kb, flat, self.embedder, k)
            return found.select(F.lit(0).cast("bigint").alias("qid"), F.col("qid").alias("fid"), F.col("id").alias("item"), "rk", "chunk")

        start, every = self.spark.createDataFrame([(0, asked)], "qid bigint, payload string"), []
        for kind, hop, frame in hop_events(start, search, self.reasoner, self.settings, cut):
            if kind == "hits":
                every.append(frame)
                found = contexts(frame, ["qid", "fid"], layout="display").orderBy("fid").collect()  # one row a follow-up
                yield Event(f"hop {hop}", "\n\n".join(r["context"] for r in found) or NO_HITS, "")
        first: dict[str, str] = {}
        for frame in every:  # at most hops * follow-ups * k rows
            for r in frame.orderBy("fid", "rk").select("item", "chunk").collect():
                first.setdefault(r["item"], r["chunk"])
        hits = self.spark.createDataFrame([(0, c, i + 1) for i, c in enumerate(first.values())], "qid bigint, chunk string, rk int")
        text = self._write(synthesis_prompt(self._question(asked), hits)) if first else NO_HITS
        yield Event("local", f"{len(first)}", text)

    def stream(self, question: str, history: list[tuple[str, str]] = (), multi_hop: bool = False, table_format: bool = False) -> Iterator[Event]:
        """The stages of an answer; the last event holds the final one."""
        asked = self._ask(question, list(history))
        has_local = self.bases.exists(self.kb, "vectors")
        yield Event("start", "", "")
        with ThreadPoolExecutor(1) as pool:
            pending = pool.submit(self._web, question) if self.provider else None
            local = ""
            if has_local:
                try:
                    for event in self._hops(asked) if multi_hop and self.reasoner else self._simple(asked):
                        local = event.answer or local
                        yield event
                except Exception as x:  # shown; the web may still answer
                    yield Event("local failed", f"{type(x).__name__}: {x}", local)
            web = ""
            if pending:
                try:
                    web = pending.result()
                except Exception as x:
                    yield Event("web failed", f"{type(x).__name__}: {x}", local)
                yield Event("web", web or NO_WEB, local)
        usable = local if local != NO_HITS else ""
        parts = self.spark.createDataFrame([(0, asked, web, usable)], "qid bigint, question string, web string, local string")
        kind = parts.select(route(F.length("web") > 0, F.length("local") > 0)).first()[0]
        if kind in ("merge", "web"):
            try:
                text = self._write(parts.select("qid", parallel_prompt(F.col("question"), F.col("web"), F.col("local"), table_format).alias("prompt")))
            except Exception as x:  # the local answer stands
                yield Event("merge failed", f"{type(x).__name__}: {x}", usable)
                text = usable
        else:
            text = usable or (NO_HITS if has_local else NOTHING)
        yield Event(kind, web or NO_WEB, text)
