"""Multi-hop retrieval: search, reason about what is missing, search again; all questions of a batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.config import Settings

from .merge import keep_first
from .prompts import contexts, reasoning_trace


class Reasoner(Protocol):
    """Judges the hits of one hop: (qid, follow_ups ARRAY, is_sufficient) for every question in the hits."""

    def reason(self, hop: int, hits: DataFrame) -> DataFrame: ...


class Generator(Protocol):
    """Writes answers: adds `answer` to (qid, prompt)."""

    def generate(self, prompts: DataFrame) -> DataFrame: ...


class TemplateGenerator:
    """Offline stand-in for a language model: echoes the start of its prompt."""

    def generate(self, prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("answer", F.concat(F.lit("[answer] "), F.substring("prompt", 1, 200)))


class ScriptedReasoner:
    """Follow-ups by a given expression over each question's hits, sufficient after a given hop."""

    def __init__(self, follow_ups: Callable[[DataFrame], DataFrame], enough_at: int = 99):
        self.follow_ups, self.enough_at = follow_ups, enough_at

    def reason(self, hop: int, hits: DataFrame) -> DataFrame:
        return self.follow_ups(hits).withColumn("is_sufficient", F.lit(hop >= self.enough_at))


#: (queries with qid, fid, payload; k) -> hits with qid, fid, item, rk
SearchFn = Callable[[DataFrame, int], DataFrame]


def follow_up_queries(reasoned: DataFrame) -> DataFrame:
    """One row per follow-up of a question that is not answered yet: qid, fid, payload. Null lists give none."""
    open_ = reasoned.where(~F.coalesce("is_sufficient", F.lit(False)))
    return open_.select("qid", F.posexplode("follow_ups").alias("fid", "payload")).withColumn("fid", F.col("fid").cast("bigint"))


def hop_events(questions: DataFrame, search: SearchFn, reasoner: Reasoner, settings: Settings, cut: Callable[[DataFrame], DataFrame]) -> Iterator[tuple[str, int, DataFrame | None]]:
    """The hops as events ("hits" | "reasoned" | "end", hop, frame), for progress displays and for `multihop`.

    questions: qid, payload. `cut` materialises a frame (checkpoint() or a written table), so that the
    plan of a hop never holds those before it. A question leaves the loop once it is answered or has
    no follow-ups; the loop ends when none is left or the hops are used up.
    """
    active = cut(questions.select("qid", F.lit(0).cast("bigint").alias("fid"), "payload"))
    for hop in range(settings.hops):
        hits = cut(search(active, settings.first_k if hop == 0 else settings.refined_k).withColumn("hop", F.lit(hop)))
        yield "hits", hop, hits
        reasoned = reasoner.reason(hop, hits)
        yield "reasoned", hop, reasoned
        if hop + 1 == settings.hops:
            break
        active = cut(follow_up_queries(reasoned))
        if active.isEmpty():
            break
    yield "end", settings.hops, None


def multihop(questions: DataFrame, search: SearchFn, reasoner: Reasoner, settings: Settings, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All hits of all hops in order of arrival, without repeats of an item within a question: qid, item, hop, fid, rk."""
    parts = [frame for kind, _, frame in hop_events(questions, search, reasoner, settings, cut) if kind == "hits"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ordered = out.select("qid", "item", F.struct("hop", "fid", "rk").alias("at"))
    first = keep_first(ordered.withColumn("o", F.col("at")), ["qid", "item"], "at")
    return first.select("qid", "item", F.col("o.hop").alias("hop"), F.col("o.fid").alias("fid"), F.col("o.rk").alias("rk"))


def synthesis_prompt(question: DataFrame, hits: DataFrame, table_format: bool = False, steps: DataFrame | None = None) -> DataFrame:
    """(qid, prompt): the question, the numbered hits, the steps of reasoning and the wish for a table, if any.

    hits: qid, chunk, rk. steps: qid, step, analysis, missing_info ARRAY, follow_up_queries ARRAY.
    """
    joined = question.join(contexts(hits, ["qid"]), "qid", "left")
    parts = [F.lit("## 原始查询\n"), F.col("question"), F.lit("\n\n## 检索到的信息块\n"), F.coalesce("context", F.lit("未检索到信息。"))]
    if steps is not None:
        in_order = F.array_sort(F.collect_list(F.struct("step", "analysis", "missing_info", "follow_up_queries")))
        joined = joined.join(steps.groupBy("qid").agg(in_order.alias("_steps")), "qid", "left")
        parts += [F.lit("\n\n## 推理过程\n"), reasoning_trace(F.col("_steps"))]
    if table_format:
        parts.append(F.lit("\n\n请尽可能以Markdown表格格式组织你的回答。"))
    return joined.select("qid", F.concat(*parts).alias("prompt"))


def answer(question: DataFrame, hits: DataFrame, generator: Generator, table_format: bool = False, steps: DataFrame | None = None) -> DataFrame:
    """(qid, answer); a question without hits gets a fixed text."""
    have = hits.select("qid").distinct().withColumn("_has", F.lit(True))
    made = generator.generate(synthesis_prompt(question, hits, table_format, steps)).join(have, "qid", "left")
    return made.select("qid", F.when(F.col("_has"), F.col("answer")).otherwise(F.lit("未找到相关信息。")).alias("answer"))
