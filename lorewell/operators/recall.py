"""Recall and ranking of fetched results for a question: by keywords, or by vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.config import Settings
from lorewell.functions.text import sentence
from lorewell.functions.vector import cosine

from .chunking import segment_column
from .embed import Embedder, embed_column
from .merge import best, joined_text

Keywords = list[tuple[str, float]]


def keywords_tfidf(docs: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """(key, word, weight, rk): the k words of each text with the highest tf x ln(N / df), rounded to 6 places.

    Words are runs of letters, lower-cased. Ties go by the word. Texts without words give no row.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), lambda w: w != "")
    # the length of the text travels with its words, so that it needs no join of its own
    tf = docs.select(key, words.alias("words")).select(key, F.size("words").alias("n"), F.explode("words").alias("word")).groupBy(key, "n", "word").agg(F.count("*").alias("tf"))
    total = docs.count()
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    # a word of more than a thousandth of the texts is common; texts hold a bounded number of distinct words on average, so there are few of them
    common = df.where(F.col("df") > max(total // 1000, 1000))
    weight = F.round(F.col("tf") / F.col("n") * F.log(F.lit(total) / F.col("df")), 6)
    held = tf.join(F.broadcast(common), "word", "left")
    rare = held.where("df IS NULL").drop("df").join(df.where(F.col("df") <= max(total // 1000, 1000)), "word")
    scored = held.where("df IS NOT NULL").unionByName(rare).select(key, "word", weight.alias("weight"))
    return best(scored, [key], [F.desc("weight"), F.asc("word")], k)


def scaled_keywords(keywords: Keywords) -> Keywords:
    """Weights scaled so that they add up to the number of keywords, rounded to 4 places; empty without weight."""
    total = sum(w for _, w in keywords)
    return [(k, round(w * len(keywords) / total, 4)) for k, w in keywords] if total else []


def title_score(title: Column, keywords: Keywords) -> Column:
    """Sum of the weights of the keywords that the title contains."""
    parts = [F.when(F.contains(title, F.lit(k)), F.lit(w)).otherwise(F.lit(0.0)) for k, w in keywords]
    return sum(parts, F.lit(0.0))


def sentence_score(text: Column, keywords: Keywords, mode: str = "compat") -> Column:
    """compat: the same sum of weights for every sentence; count: weights times occurrences."""
    if mode == "compat":
        return F.lit(float(sum(w for _, w in keywords)))
    occurrences = lambda k: (F.length(text) - F.length(F.replace(text, F.lit(k), F.lit("")))) / len(k)
    return sum((F.lit(w) * occurrences(k) for k, w in keywords if k), F.lit(0.0))


def score_titles(pages: DataFrame, keywords: Keywords) -> DataFrame:
    """(title, pos, score): one row per distinct title, with its first position. Null titles score like empty ones."""
    return pages.groupBy("title").agg(F.min("pos").alias("pos")).withColumn("score", F.round(title_score(F.coalesce("title", F.lit("")), keywords), 4))


def top_titles(pages: DataFrame, keywords: Keywords, k: int) -> DataFrame:
    """The k best titles: highest score, then first seen."""
    return score_titles(pages, keywords).orderBy(F.desc("score"), F.asc("pos")).limit(k)


def sentences_of(pages: DataFrame, settings: Settings) -> DataFrame:
    """(sentence, pos, ordinal): distinct normalised sentences of at least min_sentence characters, with their first place."""
    pieces = pages.select("pos", F.posexplode(segment_column(F.col("text"), settings.segment_length)).alias("ordinal", "piece"))
    kept = pieces.select("pos", "ordinal", sentence(F.col("piece")).alias("sentence")).where(F.length("sentence") >= settings.min_sentence)
    first = kept.groupBy("sentence").agg(F.min(F.struct("pos", "ordinal")).alias("at"))
    return first.select("sentence", F.col("at.pos").alias("pos"), F.col("at.ordinal").alias("ordinal"))


def recall_by_keywords(pages: DataFrame, keywords: Keywords, settings: Settings, mode: str = "compat") -> DataFrame:
    """One row, `background`: the best sentences of the pages with the best titles, joined by line ends."""
    titles = top_titles(pages, keywords, settings.top_titles).select("title")
    # at most top_titles rows
    chosen = pages.join(F.broadcast(titles), pages["title"].eqNullSafe(titles["title"]), "left_semi")
    scored = sentences_of(chosen, settings).withColumn("score", sentence_score(F.col("sentence"), keywords, mode))
    top = scored.orderBy(F.desc("score"), F.asc("pos"), F.asc("ordinal")).limit(settings.top_sentences)
    ranked = top.withColumn("rk", F.row_number().over(W.orderBy(F.desc("score"), F.asc("pos"), F.asc("ordinal"))))
    return ranked.agg(joined_text(F.col("rk"), F.col("sentence"), "\n").alias("background"))


def _nearest(items: DataFrame, text: str, question: list[float], embedder: Embedder, k: int, digits: int = 6) -> DataFrame:
    """The k items nearest to the question by cosine; items of equal score collapse into the last. items: ordinal, and `text`."""
    asked = F.array(*map(F.lit, question))
    scored = embed_column(items, text, embedder).where("vector IS NOT NULL").withColumn("score", F.round(cosine(F.col("vector"), asked), digits) + 0.0)
    last = scored.groupBy("score").agg(F.max_by(text, "ordinal").alias(text), F.max("ordinal").alias("ordinal"))
    return last.orderBy(F.desc("score")).limit(k)


def recall_by_vectors(pages: DataFrame, question: str, embedder: Embedder, settings: Settings) -> DataFrame:
    """One row, `background`, ranked by the vectors of titles and sentences, for a single question. Blank questions have none."""
    asked = [float(x) for x in embedder.embed([question])[0]]
    titles = pages.select(F.col("pos").alias("ordinal"), "title").where("title IS NOT NULL")
    # at most top_titles rows
    chosen = _nearest(titles, "title", asked, embedder, settings.top_titles).select("title").distinct()
    sentences = sentences_of(pages.join(F.broadcast(chosen), "title", "left_semi"), settings)
    placed = sentences.select(F.struct("pos", "ordinal").alias("ordinal"), "sentence")
    top = _nearest(placed, "sentence", asked, embedder, settings.top_sentences)
    return top.agg(joined_text(-F.col("score"), F.col("sentence"), "\n").alias("background"))
