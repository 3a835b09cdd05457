"""Contexts, previews, history and routing of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.functions.text import preview

from .merge import best, joined_text

# How the numbered blocks of each context layout begin, and what follows the heading.
LAYOUTS: dict[str, tuple[str, str]] = {
    "chunk": ("[Chunk ", "]: "),
    "display": ("**检索块 ", "**: "),
    "reference": ("// --- [Reference Code ", "] ---\n"),
    "bold": ("**相关信息 ", "**: "),
    "plain": ("[相关信息 ", "]: "),
}


def block(rank: Column, text: Column, layout: str = "chunk") -> Column:
    before, after = LAYOUTS[layout]
    return F.concat(F.lit(before), rank.cast("string"), F.lit(after), text)


def contexts(hits: DataFrame, by: list[str], text: str = "chunk", rank: str = "rk", layout: str = "chunk") -> DataFrame:
    """One row per group: its hits as numbered blocks with blank lines between. Groups are the hits of a query, bounded by its top-k."""
    return hits.groupBy(*by).agg(joined_text(F.col(rank), block(F.col(rank), F.col(text), layout), "\n\n").alias("context"))


def previews(hits: DataFrame, by: list[str], text: str = "chunk", rank: str = "rk", first: int = 3, chars: int = 100) -> DataFrame:
    """The first few hits of each group, each cut to its first characters."""
    return hits.where(F.col(rank) <= first).select(*by, rank, preview(F.col(text), chars).alias("preview"))


def summary(hits: DataFrame, by: list[str], text: str = "chunk", rank: str = "rk", first: int = 10) -> DataFrame:
    """Per group: its first hits as display blocks, and how many more there are. Repeated hits count."""
    shown = F.when(F.col(rank) <= first, F.struct(F.col(rank).alias("r"), block(F.col(rank), F.col(text), "display").alias("t")))
    agg = hits.groupBy(*by).agg(F.array_sort(F.collect_list(shown)).alias("s"), F.count("*").alias("n_hits"))
    return agg.select(*by, F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("summary"), F.greatest(F.col("n_hits") - first, F.lit(0)).cast("bigint").alias("n_more"))


def ranked_summary(rows: DataFrame, by: list[str], order: list[Column], text: str, first: int = 10) -> DataFrame:
    """`summary` of rows without ranks. Only the first rows of a group are ever ranked; the others are counted."""
    shown = best(rows, by, order, first)
    blocks = shown.groupBy(*by).agg(joined_text(F.col("rk"), block(F.col("rk"), F.col(text), "display"), "\n\n").alias("summary"))
    more = rows.groupBy(*by).agg(F.greatest(F.count("*") - first, F.lit(0)).cast("bigint").alias("n_more"))
    return blocks.join(more, by)


def history_prompt(turns: DataFrame, last: int = 3) -> DataFrame:
    """(conv_id, history): the last few question and answer pairs of each conversation, in order.

    turns: conv_id, turn, user_text, assistant_text. Only the last pairs are ever kept: Spark cuts each
    partition to them before the shuffle.
    """
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= last)
    line = F.concat(F.lit("用户："), F.coalesce("user_text", F.lit("")), F.lit("\n助手："), F.coalesce("assistant_text", F.lit("")), F.lit("\n"))
    return kept.groupBy("conv_id").agg(joined_text(F.col("turn"), line, "").alias("history"))


# The wordings around the history of a conversation.
WITH_HISTORY, EARLIER, NOW = "基于以下对话历史，回答用户的当前问题。\n", "之前的对话内容：\n", "\n当前问题："


def enhanced_question(question: Column, history: Column) -> Column:
    """The question with the history of its conversation before it; the bare question without history."""
    return F.when(_some(history), F.concat(F.lit(WITH_HISTORY + EARLIER), history, F.lit(NOW), question)).otherwise(question)


def route(has_web: Column, has_local: Column) -> Column:
    """Which answer to give: both merged, one of them, or none."""
    return F.when(has_web & has_local, "merge").when(has_local, "local").when(has_web, "web").otherwise("none")


def _some(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) > 0


def reasoning_trace(steps: Column) -> Column:
    """The steps of reasoning as text. steps: ARRAY<STRUCT<analysis, missing_info ARRAY, follow_up_queries ARRAY, ...>> in order; null and empty give ""."""
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    line = lambda s, i: F.concat(
        F.lit("\n\n推理步骤 "), (i + 1).cast("string"), F.lit(":\n分析: "), F.coalesce(s["analysis"], F.lit("")), F.lit("\n缺失信息: "), listed(s["missing_info"]), F.lit("\n后续查询: "), listed(s["follow_up_queries"])
    )
    return F.coalesce(F.array_join(F.transform(steps, line), ""), F.lit(""))


# Fixed value: the task that a reasoner is given.
_REASONING_TASK = """

## 你的任务
1. 分析已检索到的信息与原始查询的关系
2. 确定能够更完整回答查询的特定缺失信息
3. 提出1-3个针对性的后续查询，以检索缺失信息
4. 确定当前信息是否足够回答原始查询

以JSON格式回答，包含以下字段:
- analysis: 对当前信息的详细分析
- missing_info: 特定缺失信息的列表
- follow_up_queries: 1-3个具体的后续查询
- is_sufficient: 表示信息是否足够的布尔值

⚠️ **重要逻辑规则（必须严格遵守）**：
1. **如果你在 "missing_info" 字段中列出了任何内容，那么 "is_sufficient" 必须为 false！**
2. 只有当你完全确定当前检索到的 Chunk 已经包含了用户问题所需的所有细节（无需任何额外查询）时，"is_sufficient" 才能为 true。
3. 如果代码被截断（Chunking）导致关键部分（如行号、中间逻辑）丢失，必须标记为不完整。"""


def reasoning_prompt(question: Column, previous: Column, context: Column, hop: Column) -> Column:
    """What a reasoner is asked after a hop. previous: ARRAY of earlier queries; context: the hop's numbered hits."""
    asked = F.array_join(F.transform(previous, lambda q, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), F.coalesce(q, F.lit("")))), "\n")
    return F.concat(
        F.lit("## 原始查询\n"), question, F.lit("\n\n## 先前查询（如果有）\n"), F.when(_some(asked), asked).otherwise("无"),
        F.lit("\n\n## 检索到的信息（跳数 "), hop.cast("string"), F.lit("）\n"), F.when(_some(context), context).otherwise("未检索到信息。"), F.lit(_REASONING_TASK),
    )


def parallel_prompt(question: Column, web: Column, local: Column, table_format: bool = False) -> Column:
    """The prompt that merges web background and local answer, or asks with the web background alone; null where no answer has to be written."""
    table = "请尽可能以Markdown表格的形式呈现结构化信息。\n\n" if table_format else ""
    merge = F.concat(F.lit("问题："), question, F.lit("\n\n网络搜索结果："), web, F.lit("\n\n本地知识库分析："), local, F.lit(f"\n\n{table}请根据以上信息，提供一个综合的回答。"))
    alone = F.concat(F.lit("问题："), question, F.lit("\n\n[联网搜索结果]："), web, F.lit(f"\n\n{table}".rstrip()))
    kind = route(_some(web), _some(local))
    return F.when(kind == "merge", merge).when(kind == "web", alone)


def parallel_answer(written: Column, local: Column) -> Column:
    """The answer written to `parallel_prompt`, else the local one, else a fixed text."""
    return F.when(_some(written), written).when(_some(local), local).otherwise("未找到相关信息。")
