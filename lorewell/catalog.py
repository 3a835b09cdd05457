"""Queries over the engine's own operators, one a survey item or group of items, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.config import Settings
from lorewell.functions import text as tx
from lorewell.functions import vector as vx
from lorewell.operators import chunking, embed, merge, multihop, prompts, recall
from lorewell.operators import search as vs
from lorewell.plans.ingest import ingest_chunks as ingest_plan
from lorewell.plans.session import cut, shared_folder, table
from lorewell.sources import files
from lorewell.sources import pages as pg
from lorewell.sources.knowledge_base import KnowledgeBases

SETTINGS = Settings()

#: A question's keywords, for the recall queries.
KEYWORDS = recall.scaled_keywords([("fifo", 2.0), ("notes", 1.0), ("设计", 1.5), ("Takt", 0.5), ("registre", 1.0)])

_QUERY = "vec_id % 50 = 0"


def _docs(spark, d):
    return table(spark, d, "documents")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), "label")


def _questions(spark, d):
    return table(spark, d, "embeddings").where(_QUERY).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def _pages(spark, d):
    return table(spark, d, "web_results").select(F.col("page_id").alias("pos"), "url", "title", "text")


def _titled_docs(spark, d):
    return _docs(spark, d).where("source IS NOT NULL").select("source", "doc_id", F.coalesce("title", F.lit("")).alias("title"))


def _ranked_docs(spark, d, k):
    return merge.best(_titled_docs(spark, d), ["source"], [F.asc("doc_id")], k)


def _bases(spark) -> KnowledgeBases:
    return KnowledgeBases(spark, f"{shared_folder(spark)}/lorewell/kb-{uuid.uuid4().hex}", SETTINGS)


def _merged_base(spark, d) -> tuple[KnowledgeBases, str, list[tuple[int, int]]]:
    """A knowledge base after two uploads of the chunk ledger, and the counts of each."""
    rows = table(spark, d, "semantic_chunk_output").select("pos", "id", "chunk", "source", "method", "batch_no")
    bases = _bases(spark)
    kb = bases.create("ledger")
    counts = [bases.merge(kb, rows.where(part).drop("batch_no")) for part in ("batch_no <= 5", "batch_no > 5")]
    return bases, kb, counts


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


def doc_gate(spark: SparkSession, d: str) -> DataFrame:
    return clean_text(spark, d).where(tx.document_gate(F.col("clean"))).select("doc_id", F.length("clean").cast("bigint").alias("n"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), tx.clean_text(F.col("text")).alias("t")).where(tx.document_gate(F.col("t")))
    parts = docs.select("doc_id", "source", F.posexplode(chunking.char_windows(F.col("t"))).alias("i", "chunk")).where(F.length("chunk") >= 20)
    return parts.select("doc_id", F.col("i").cast("bigint").alias("i"), tx.chunk_id(F.col("source"), F.col("chunk")).alias("id"), "chunk")


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, d)).select("source", "ordinal", "id", "chunk", "method")


def chunk_numbered(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents_numbered(_docs(spark, d))


def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ingest_plan(_docs(spark, d).select(F.col("doc_id").alias("file_no"), "source", "ext", "text"))


def embed_input(spark: SparkSession, d: str) -> DataFrame:
    cut_ = tx.embed_input(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length(cut_).cast("bigint").alias("n")).where("n IS NOT NULL")


def blank_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "semantic_chunk_output").where(tx.not_blank(F.col("chunk"))).select("pos")


def _components(df: DataFrame, key: str) -> DataFrame:
    v = df.select(key, F.posexplode("vector").alias("i", "x"))
    return v.select(key, F.col("i").cast("bigint").alias("i"), F.col("x").cast("double").alias("x"))


def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    return _components(embed.embed_column(_docs(spark, d).select("doc_id", "text"), "text", embed.LetterEmbedder()), "doc_id")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "web_results").where(tx.not_blank(F.col("query_text"))).select("query_text").distinct()
    return _components(embed.embed_column(asked, "query_text", embed.LetterEmbedder()), "query_text")


def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Three tokens a text: the vector, its double, and its negative, of which the masks leave one to three."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    tokens = F.array("e", F.transform("e", lambda x: x * 2), F.transform("e", lambda x: -x))
    mask = F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"), (F.col("vec_id") % 3 == 0).cast("int"))
    v = e.select("vec_id", F.posexplode(vx.mean_pool(tokens, mask)).alias("i", "x"))
    return v.select("vec_id", F.col("i").cast("bigint").alias("i"), (F.round("x", 6) + 0.0).alias("x"))


def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "semantic_chunk_output").where("id IS NOT NULL").select("pos", "id", "chunk")
    return _components(embed.embed_missing(chunks, table(spark, d, "semantic_chunk_vector"), embed.LetterEmbedder()), "pos").where("x > 0")


def kb_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "semantic_chunk_output").select("id", "pos", "chunk", "source", "method")
    return merge.upsert(rows, "id", "pos")


def kb_list(spark: SparkSession, d: str) -> DataFrame:
    bases = _bases(spark)
    # one row a knowledge base
    for (name,) in table(spark, d, "kb_files").where("kb IS NOT NULL AND trim(kb) <> ''").select("kb").distinct().collect():
        if not bases.exists(name):
            bases.create(name)
    return spark.createDataFrame([(n,) for n in bases.list()], "kb string")


def kb_file_list(spark: SparkSession, d: str) -> DataFrame:
    bases, kb, _ = _merged_base(spark, d)
    return bases.files(kb)


def kb_ingest(spark: SparkSession, d: str) -> DataFrame:
    bases, kb, _ = _merged_base(spark, d)
    return bases.chunks(kb).select("id", "chunk", "source", "method", F.col("metadata.source").alias("file"))


def kb_counts(spark: SparkSession, d: str) -> DataFrame:
    _, _, counts = _merged_base(spark, d)
    return spark.createDataFrame([(i, total, new) for i, (total, new) in enumerate(counts)], "upload bigint, total bigint, n_new bigint")


def kb_search(spark: SparkSession, d: str) -> DataFrame:
    bases, kb, _ = _merged_base(spark, d)
    bases.embed(kb, embed.LetterEmbedder())
    asked = _docs(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("text").alias("question"))
    hits = bases.search(kb, asked, embed.LetterEmbedder(), SETTINGS.top_k)
    return hits.select("qid", F.col("rk").cast("bigint").alias("rk"), "id", "chunk", "score")


def kb_names(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.kb_name(F.col("title")).alias("name"))


def file_extensions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_files").select("file_id", tx.file_extension(F.col("name")).alias("ext"))


def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    return chunking.batch_plan(_docs(spark, d), SETTINGS.embed_batch)


def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(vx.l2_normalise(F.col("embedding"))).alias("i", "x"))
    return v.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


def _top(spark, d, metric):
    hits = vs.search(_questions(spark, d), _vectors(spark, d), SETTINGS.top_k, metric)
    return hits.select("qid", "pos", "score", F.col("rk").cast("bigint").alias("rk"))


def topk_ip(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "ip")


def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "cosine")


def topk_l2(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "l2")


def search_chunks(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "semantic_chunk_vector").select(F.col("vec_no").alias("pos"), "id", "vector")
    q = v.where("pos % 50 = 0").select(F.col("pos").alias("qid"), "vector").where(F.size("vector") == 64)
    hits = vs.search(q, v.where(F.size("vector") == 64), SETTINGS.top_k, "ip")
    return hits.join(v.select("pos", "id"), "pos").select("qid", "pos", "id", "score", F.col("rk").cast("bigint").alias("rk"))


def index_plan(spark: SparkSession, d: str) -> DataFrame:
    return vs.index_plan(table(spark, d, "semantic_chunk_vector"))


def ivf_probe1(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    means = v.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # one row per label: every label is a cell
    rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c")).orderBy("label").collect()
    q = vs.assign_cells(_questions(spark, d), [(r["label"], r["c"]) for r in rows])
    hits = vs.search_cells(q, v.withColumn("cell", F.col("label").cast("bigint")), SETTINGS.top_k)
    return hits.select("qid", "pos", "distance", F.col("rk").cast("bigint").alias("rk"))


def ivf_kmeans(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "semantic_chunk_vector").where(F.size("vector") == 64).where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x))).select(F.col("vec_no").alias("pos"), "vector")
    plan = vs.index_plan(v).first()
    cells = [(int(r.cell), r.centroid) for r in vs.train_cells(v, plan["nlist"]).itertuples()]
    q = vs.assign_cells(v.where("pos % 50 = 0").withColumnRenamed("pos", "qid"), cells, metric="l2")
    hits = vs.search_cells(q, vs.assign_cells(v, cells, metric="l2"), SETTINGS.top_k)
    return hits.select("qid", "pos", "distance", F.col("rk").cast("bigint").alias("rk"))


def rank_by_score_dedup(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    question = v.orderBy("pos").select("vector").first()[0]
    scored = v.select("pos", (F.round(vx.dot(F.col("vector"), F.array(*map(F.lit, question))), 2) + 0.0).alias("score"))
    return merge.collapse_scores(scored, "score", "pos")


def page_results(spark: SparkSession, d: str) -> DataFrame:
    return pg.result_links(_pages(spark, d)).select("url", "pos", "title")


def web_background(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("pos", tx.web_background(F.col("text"), SETTINGS.background_cap).alias("background"))


def segment_text(spark: SparkSession, d: str) -> DataFrame:
    parts = _pages(spark, d).select("pos", F.posexplode(chunking.segment_column(F.col("text"), SETTINGS.segment_length)).alias("i", "segment"))
    return parts.select("pos", F.col("i").cast("bigint").alias("i"), "segment")


def recall_sentences(spark: SparkSession, d: str) -> DataFrame:
    return recall.sentences_of(_pages(spark, d), SETTINGS).select("sentence", "pos")


def sentence_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("pos", tx.sentence(F.col("text")).alias("sentence")).where(F.length("sentence") >= SETTINGS.min_sentence)


def page_extract(spark: SparkSession, d: str) -> DataFrame:
    """The pages' lines as paragraphs of HTML, read back."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<div>menu</div><p>"), F.replace(escaped, F.lit("\n"), F.lit("</p>gap<p>")), F.lit("</p>"))
    return pg.extract_pages(_pages(spark, d).select("pos", html.alias("html"))).select("pos", "text")


def decode_files(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", files.decode_column(F.encode("text", "UTF-8")).alias("text"))


def decode_detected(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 1, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    return _docs(spark, d).select("doc_id", files.detected_column(raw).alias("text"))


def keywords_tfidf(spark: SparkSession, d: str) -> DataFrame:
    k = recall.keywords_tfidf(_docs(spark, d), "doc_id", "text", SETTINGS.top_keywords)
    return k.select("doc_id", "word", "weight", F.col("rk").cast("bigint").alias("rk"))


def title_score(spark: SparkSession, d: str) -> DataFrame:
    return recall.score_titles(_pages(spark, d), KEYWORDS)


def title_top(spark: SparkSession, d: str) -> DataFrame:
    return recall.top_titles(_pages(spark, d), KEYWORDS, SETTINGS.top_titles)


def recall_keywords(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall_by_keywords(_pages(spark, d), KEYWORDS, SETTINGS)


def history_prompt(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("user_text"), F.col("props").alias("assistant_text"))
    return prompts.history_prompt(turns, SETTINGS.history_turns)


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    hits = _ranked_docs(spark, d, 5)
    return hits.groupBy("source").agg(*(merge.joined_text(F.col("rk"), prompts.block(F.col("rk"), F.col("title"), name), "\n\n").alias(name) for name in prompts.LAYOUTS))


def previews(spark: SparkSession, d: str) -> DataFrame:
    return prompts.previews(_ranked_docs(spark, d, 5), ["source"], "title", first=3, chars=12).withColumn("rk", F.col("rk").cast("bigint"))


def analysis_previews(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.preview(F.col("text"), SETTINGS.analysis_preview).alias("preview"))


def keyword_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("w"), F.col("l_quantity").cast("double").alias("total"))
    return rows.select("l_orderkey", "l_linenumber", tx.keyword_weight(F.col("w"), F.col("total")).alias("weight"))


def hit_summary(spark: SparkSession, d: str) -> DataFrame:
    return prompts.ranked_summary(_titled_docs(spark, d), ["source"], [F.asc("doc_id")], "title")


def reasoning_parse(spark: SparkSession, d: str) -> DataFrame:
    """Reasoning steps made of the events: whole ones, sufficient ones, with missing keys, cut off, of another kind, and null."""
    e, u = F.col("event_type"), F.col("user_id").cast("string")
    whole = F.concat(F.lit('{"analysis": "'), e, F.lit('", "missing_info": ["'), u, F.lit('", "b"], "follow_up_queries": ["q'), u, F.lit('"], "is_sufficient": '))
    kind = F.col("event_id") % 6
    made = (
        F.when(kind == 0, F.concat(whole, F.lit("false}")))
        .when(kind == 1, F.concat(whole, F.lit("true}")))
        .when(kind == 2, F.concat(F.lit('{"analysis": "'), e, F.lit('"}')))
        .when(kind == 3, whole)
        .when(kind == 4, F.concat(F.lit('["'), u, F.lit('"]')))
    )
    r = table(spark, d, "events").select("event_id", tx.parse_reasoning(made).alias("r"))
    joined = lambda c: F.array_join(c, "|")
    return r.select("event_id", "r.analysis", joined("r.missing_info").alias("missing"), joined("r.follow_up_queries").alias("follow_up"), tx.yes_no(F.col("r.is_sufficient")).alias("sufficient"))


def reasoning_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).select("pos", F.coalesce("title", F.lit("")).alias("question"), F.split("url", "/").alias("previous"), F.substring("text", 1, 40).alias("context"))
    return p.select("pos", prompts.reasoning_prompt(F.col("question"), F.col("previous"), F.col("context"), F.lit(1)).alias("prompt"))


def parallel_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each page as a question with its background as web result and its title as local answer; the answers are the prompts' echo."""
    p = table(spark, d, "web_results").select(F.col("page_id").alias("pos"), F.coalesce("query_text", F.lit("")).alias("q"), tx.web_background(F.col("text"), SETTINGS.background_cap).alias("w"), F.col("title").alias("l"))
    p = p.withColumn("prompt", prompts.parallel_prompt(F.col("q"), F.col("w"), F.col("l")))
    written = multihop.TemplateGenerator().generate(p)
    return written.select("pos", "prompt", prompts.parallel_answer(F.col("answer"), F.col("l")).alias("answer"))


def answer_route(spark: SparkSession, d: str) -> DataFrame:
    """How many questions of the web log can be answered from pages, from files of their name in the ledger, from both or neither."""
    asked = table(spark, d, "web_results").groupBy("query_text").agg(F.max(tx.not_blank(F.col("text"))).alias("web"), F.max(F.col("title").isNotNull() & (F.col("page_id") % 3 == 0)).alias("local"))
    return asked.groupBy(prompts.route(F.col("web"), F.col("local")).alias("route")).agg(F.count("*").alias("n"))


def _hop_search(corpus: DataFrame) -> multihop.SearchFn:
    def run(queries: DataFrame, k: int) -> DataFrame:
        hits = vs.search(queries.select("qid", "fid", "payload"), corpus, k, "ip", q_key=["qid", "fid"], q_vector="payload")
        return hits.select("qid", "fid", F.col("pos").alias("item"), "rk")

    return run


def multihop_search(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)

    def second_hit(hits: DataFrame) -> DataFrame:
        return hits.where("rk = 2").join(v.select(F.col("pos").alias("item"), "vector"), "item").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("fid", "vector"))), lambda s: s["vector"]).alias("follow_ups"))

    questions = _questions(spark, d).withColumnRenamed("vector", "payload")
    hits = multihop.multihop(questions, _hop_search(v), multihop.ScriptedReasoner(second_hit), SETTINGS, cut)
    return hits.select("qid", "item", F.col("hop").cast("bigint").alias("hop"), F.col("rk").cast("bigint").alias("rk"))


def simple_answer(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "semantic_chunk_vector").select(F.col("vec_no").alias("pos"), F.coalesce("chunk", F.lit("")).alias("chunk"))
    hits = search_chunks(spark, d).join(chunks, "pos")
    asked = table(spark, d, "semantic_chunk_vector").where("vec_no % 50 = 0").select(F.col("vec_no").alias("qid"), F.concat(F.lit("question "), F.col("vec_no")).alias("question"))
    return multihop.answer(asked, hits, multihop.TemplateGenerator())


_QUERIES = [
    clean_text, doc_gate, chunk_windows, chunk_documents, chunk_numbered, ingest_chunks, embed_input, blank_filter, embed_documents, missing_vectors, kb_upsert,
    kb_list, kb_file_list, kb_names, file_extensions, batch_plan, l2_normalise, topk_ip, topk_cosine, topk_l2, search_chunks, index_plan, ivf_probe1, ivf_kmeans,
    rank_by_score_dedup, page_results, web_background, segment_text, recall_sentences, keywords_tfidf, title_score, title_top, recall_keywords, history_prompt,
    context_blocks, previews, hit_summary, reasoning_parse, answer_route, multihop_search, simple_answer, query_vectors, mean_pool, kb_ingest, kb_counts, kb_search,
    sentence_normalise, page_extract, decode_files, decode_detected, analysis_previews, keyword_weights, reasoning_prompts, parallel_answers,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_WS = r"[\t\n\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WS_V = _WS.replace(r"\f", r"\x{0B}\f").replace(r"\x{1C}-\x{1F}", "")
_CLEAN = rf"trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '{_WS}+', ' ', 'g'))"
_WEIGHTS = " + ".join(f"CASE WHEN contains(coalesce(title, ''), '{k}') THEN {w} ELSE 0.0 END" for k, w in KEYWORDS)
_TITLES = f"SELECT title, min(page_id) AS pos, round({_WEIGHTS}, 4)::DOUBLE AS score FROM web_results GROUP BY title"
_RANKED = "SELECT source, doc_id, coalesce(title, '') AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents WHERE source IS NOT NULL QUALIFY rk <= {}"


def _top_sql(score: str) -> str:
    return f"""SELECT q.vec_id AS qid, c.vec_id AS pos, round({score}, 6) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round({score}, 6) DESC, c.vec_id) AS rk
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0) q, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) c
        QUALIFY rk <= 5"""


def _hop_sql(name: str, source: str, k: int) -> str:
    return f"""{name} AS (SELECT q.qid, c.vec_id AS item, row_number() OVER (PARTITION BY q.qid ORDER BY round(list_dot_product(q.e, c.e), 6) DESC, c.vec_id) AS rk
        FROM ({source}) q, v c QUALIFY rk <= {k})"""


_LETTERS = "list_transform(generate_series(0, 25), lambda i: (2 * length({0}) - length(replace({0}, chr(97 + i::INT), '')) - length(replace({0}, chr(65 + i::INT), '')))::DOUBLE)"
_UPSERTED = """SELECT id, min(pos) AS pos, arg_max({'v': chunk}, pos).v AS chunk, arg_max({'v': source}, pos).v AS source, arg_max({'v': method}, pos).v AS method
            FROM semantic_chunk_output WHERE id IS NOT NULL GROUP BY id"""
_FOUND = """WITH v AS (SELECT vec_no, id, chunk, vector::DOUBLE[] AS e FROM semantic_chunk_vector
                WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            f AS (SELECT q.vec_no AS qid, c.vec_no AS pos, c.id, c.chunk, round(list_dot_product(q.e, c.e), 6) AS score,
            row_number() OVER (PARTITION BY q.vec_no ORDER BY round(list_dot_product(q.e, c.e), 6) DESC, c.vec_no) AS rk
            FROM v q, v c WHERE q.vec_no % 50 = 0 QUALIFY rk <= 5)"""


def _cut_sql(name: str, source: str, mark: str) -> str:
    """CTEs that cut the pieces (id, place, piece) of `source` that are too long at a mark, as `name`(id, place, piece)."""
    strip = f"regexp_replace(substr(piece, 1 + b::BIGINT, coalesce(nxt, length(piece))::BIGINT - b::BIGINT), '^{_WS_V}+|{_WS_V}+$', '', 'g')"
    after = f"list_min(list_transform(list_filter(parts, lambda x: x.b > {{0}} AND x.e > x.b AND x.e > {{0}} + {SETTINGS.segment_length - 1}), lambda x: x.b))"
    return f"""{name}_l AS (SELECT id, place, piece, list_transform(string_split(piece, {mark}), lambda x: length(x)) AS n FROM {source} WHERE length(piece) > {SETTINGS.segment_length}),
        {name}_p AS (SELECT id, place, piece, list_transform(generate_series(1, len(n)), lambda j: {{'b': coalesce(list_sum(n[1:j - 1]), 0) + j - 1, 'e': coalesce(list_sum(n[1:j]), 0) + j - 1}}) AS parts FROM {name}_l),
        {name}_c AS (SELECT id, place, piece, parts, 0::DOUBLE AS b, ({after.format("0")})::DOUBLE AS nxt FROM {name}_p
            UNION ALL SELECT id, place, piece, parts, nxt, ({after.format("nxt")})::DOUBLE FROM {name}_c WHERE nxt IS NOT NULL),
        {name} AS (SELECT id, place || [b] AS place, {strip} AS piece FROM {name}_c UNION ALL SELECT id, place || [0], piece FROM {source} WHERE length(piece) <= {SETTINGS.segment_length})"""


_SEGMENTS = f"""s0 AS (SELECT page_id AS id, []::DOUBLE[] AS place, regexp_replace(text, '^{_WS_V}+|{_WS_V}+$', '', 'g') AS piece FROM web_results WHERE text IS NOT NULL),
        {_cut_sql("s1", "s0", "chr(10)")}, {_cut_sql("s2", "s1", "'。'")}, sg AS (SELECT id AS pos, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS i, piece AS segment FROM s2)"""
_SENTENCES = rf"""{_SEGMENTS}, st AS (SELECT regexp_replace(segment, '[\x{{0B}}\x{{1C}}-\x{{1F}}{_WS[1:-1]}]+', ' ', 'g') AS sentence, pos, i FROM sg)"""


def _letters_sql(key: str, text: str, source: str) -> str:
    return f"""SELECT {key}, unnest(generate_series(0, 25)) AS i, unnest({_LETTERS.format("t")}) AS x
        FROM (SELECT {key}, substr({text}, 1, 8000) AS t FROM {source}) WHERE length(t) > 0"""


def _blocks_sql() -> str:
    shown = [(name, before.replace("'", "''"), after.replace("'", "''").replace("\n", "' || chr(10) || '")) for name, (before, after) in prompts.LAYOUTS.items()]
    return ", ".join(f"string_agg('{b}' || rk || '{a}' || title, chr(10) || chr(10) ORDER BY rk) AS {n}" for n, b, a in shown)


def oracle_sql() -> dict[str, str]:
    return {
        "clean_text": f"SELECT doc_id, {_CLEAN} AS clean FROM documents",
        "doc_gate": f"SELECT doc_id, length({_CLEAN}) AS n FROM documents WHERE length({_CLEAN}) > 10",
        "chunk_windows": f"""WITH t AS (SELECT doc_id, coalesce(source, '') AS source, {_CLEAN} AS t FROM documents),
            w AS (SELECT doc_id, source, t, unnest(generate_series(0, greatest(0, ceil((length(t) - 20) / 1980.0)::BIGINT - 1))) AS i FROM t WHERE length(t) > 10),
            c AS (SELECT doc_id, i, source, trim(substr(t, 1 + 1980 * i, 2000)) AS chunk FROM w)
            SELECT doc_id, i, md5(source || '_' || chunk) AS id, chunk FROM c WHERE length(chunk) >= 20""",
        "embed_input": "SELECT doc_id, length(substr(text, 1, 8000)) AS n FROM documents WHERE length(text) > 0",
        "blank_filter": f"SELECT pos FROM semantic_chunk_output WHERE length(regexp_replace(chunk, '{_WS_V}+', '', 'g')) > 0",
        "embed_documents": _letters_sql("doc_id", "text", "documents"),
        "query_vectors": f"""SELECT query_text, i, x FROM ({_letters_sql("query_text", "query_text", f"(SELECT DISTINCT query_text FROM web_results WHERE length(regexp_replace(query_text, '{_WS_V}+', '', 'g')) > 0)")})""",
        "mean_pool": """SELECT vec_id, unnest(generate_series(0, len(embedding)::BIGINT - 1)) AS i,
            round(unnest(embedding)::DOUBLE * (1 + 2 * (vec_id % 2) - (vec_id % 3 = 0)::INT) / (1 + vec_id % 2 + (vec_id % 3 = 0)::INT), 6) + 0.0 AS x FROM embeddings""",
        "missing_vectors": f"""SELECT pos, i, x FROM ({_letters_sql("pos", "chunk", "(SELECT * FROM semantic_chunk_output WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM semantic_chunk_vector WHERE vector IS NOT NULL AND id IS NOT NULL))")}) WHERE x > 0""",
        "kb_upsert": _UPSERTED,
        "kb_list": r"SELECT DISTINCT regexp_replace(trim(kb), '[^\p{L}\p{N}_]', '_', 'g') AS kb FROM kb_files WHERE trim(kb) <> '' UNION SELECT 'default'",
        "kb_file_list": f"SELECT DISTINCT source FROM ({_UPSERTED}) WHERE source IS NOT NULL",
        "kb_ingest": f"SELECT id, chunk, source, method, source AS file FROM ({_UPSERTED})",
        "kb_counts": """SELECT u AS upload, (SELECT count(DISTINCT id) FROM semantic_chunk_output WHERE batch_no <= b) AS total,
            (SELECT count(id) FROM semantic_chunk_output WHERE batch_no <= b AND batch_no > a) AS n_new FROM (VALUES (0::BIGINT, -1, 5), (1::BIGINT, 5, 9999)) v(u, a, b)""",
        "kb_search": f"""WITH c AS (SELECT id, pos, chunk, {_LETTERS.format("substr(chunk, 1, 8000)")} AS e FROM ({_UPSERTED}) WHERE length(chunk) > 0),
            q AS (SELECT doc_id, {_LETTERS.format("substr(text, 1, 8000)")} AS e FROM documents WHERE doc_id % 50 = 0 AND trim(text) <> '')
            SELECT doc_id AS qid, row_number() OVER (PARTITION BY doc_id ORDER BY list_dot_product(q.e, c.e) DESC, pos) AS rk, id, chunk, list_dot_product(q.e, c.e) AS score
            FROM q, c QUALIFY rk <= 5""",
        "sentence_normalise": rf"SELECT page_id AS pos, regexp_replace(text, '[\x{{0B}}\x{{1C}}-\x{{1F}}{_WS[1:-1]}]+', ' ', 'g') AS sentence FROM web_results WHERE length(sentence) >= 20",
        "page_extract": "SELECT page_id AS pos, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) AS text FROM web_results WHERE length(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))) > 15",
        "decode_files": "SELECT doc_id, text FROM documents",
        "decode_detected": "SELECT doc_id, text FROM documents",
        "analysis_previews": "SELECT doc_id, substr(text, 1, 200) || '...' AS preview FROM documents",
        "keyword_weights": "SELECT l_orderkey, l_linenumber, round(l_discount::DOUBLE * l_quantity::DOUBLE, 4) AS weight FROM lineitem",
        "reasoning_prompts": f"""SELECT page_id AS pos, '## 原始查询' || chr(10) || coalesce(title, '') || chr(10) || chr(10) || '## 先前查询（如果有）' || chr(10) ||
            CASE WHEN url IS NOT NULL THEN array_to_string(list_transform(string_split(url, '/'), lambda x, i: 'Q' || i || ': ' || x), chr(10)) ELSE '无' END ||
            chr(10) || chr(10) || '## 检索到的信息（跳数 1）' || chr(10) || CASE WHEN length(text) > 0 THEN substr(text, 1, 40) ELSE '未检索到信息。' END || '{prompts._REASONING_TASK}' AS prompt FROM web_results""",
        "parallel_answers": f"""WITH p AS (SELECT page_id AS pos, coalesce(query_text, '') AS q, substr(trim(regexp_replace(coalesce(text, ''), '{_WS_V}+', ' ', 'g')), 1, 1500) AS w, title AS l FROM web_results),
            m AS (SELECT pos, l, CASE WHEN length(w) > 0 AND length(l) > 0 THEN '问题：' || q || repeat(chr(10), 2) || '网络搜索结果：' || w || repeat(chr(10), 2) || '本地知识库分析：' || l || repeat(chr(10), 2) || '请根据以上信息，提供一个综合的回答。'
                WHEN length(w) > 0 THEN '问题：' || q || repeat(chr(10), 2) || '[联网搜索结果]：' || w END AS prompt FROM p)
            SELECT pos, prompt, CASE WHEN prompt IS NOT NULL THEN '[answer] ' || substr(prompt, 1, 200) WHEN length(l) > 0 THEN l ELSE '未找到相关信息。' END AS answer FROM m""",
        "kb_names": r"SELECT doc_id, regexp_replace(trim(title), '[^\p{L}\p{N}_]', '_', 'g') AS name FROM documents",
        "file_extensions": r"SELECT file_id, lower(regexp_extract(regexp_extract(name, '([^/]*)$', 1), '^\.*[^.].*?(\.[^.]*)$', 1)) AS ext FROM kb_files",
        "batch_plan": "SELECT (rn - 1) // 10 AS batch_no, count(*) AS n_rows FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1",
        "l2_normalise": """SELECT vec_id, unnest(generate_series(0, len(embedding)::BIGINT - 1)) AS i,
            round(unnest(embedding)::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12), 6) AS x FROM embeddings""",
        "topk_ip": _top_sql("list_dot_product(q.e, c.e)"),
        "topk_cosine": _top_sql("list_cosine_similarity(q.e, c.e)"),
        "topk_l2": _top_sql("0 - list_distance(q.e, c.e) ** 2"),
        "search_chunks": f"{_FOUND} SELECT qid, pos, id, score, rk FROM f",
        "simple_answer": f"""{_FOUND}, c AS (SELECT qid, string_agg('[Chunk ' || rk || ']: ' || coalesce(chunk, ''), repeat(chr(10), 2) ORDER BY rk) AS context FROM f GROUP BY qid)
            SELECT vec_no AS qid, CASE WHEN context IS NULL THEN '未找到相关信息。' ELSE '[answer] ' || substr('## 原始查询' || chr(10) || 'question ' || vec_no || repeat(chr(10), 2) || '## 检索到的信息块' || chr(10) || context, 1, 200) END AS answer
            FROM semantic_chunk_vector LEFT JOIN c ON vec_no = qid WHERE vec_no % 50 = 0""",
        "index_plan": """SELECT n AS n_vectors, CASE WHEN n >= 39 THEN least(n // 39, 128) ELSE 1 END::BIGINT AS nlist, CASE WHEN n >= 39 THEN 'ivf' ELSE 'flat' END AS kind,
            CASE WHEN n >= 39 THEN 'l2' ELSE 'ip' END AS metric FROM (SELECT count(*) AS n FROM semantic_chunk_vector WHERE len(vector) > 0)""",
        "ivf_probe1": """WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
            m AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM x) GROUP BY label, i),
            c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
            q AS (SELECT x.vec_id AS qid, x.e, c.label FROM x, c WHERE x.vec_id % 50 = 0
                QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_dot_product(x.e, c.c), 9) DESC, c.label) = 1)
            SELECT qid, x.vec_id AS pos, round(list_distance(q.e, x.e) ** 2, 6) AS distance,
            row_number() OVER (PARTITION BY qid ORDER BY round(list_distance(q.e, x.e) ** 2, 6), x.vec_id) AS rk
            FROM q JOIN x ON q.label = x.label QUALIFY rk <= 5""",
        "rank_by_score_dedup": """SELECT round(list_dot_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 2) + 0.0 AS score, max(c.vec_id) AS pos
            FROM embeddings c, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q GROUP BY 1""",
        "page_results": """SELECT url, page_id AS pos, trim(split_part(title, '-', 1)) AS title FROM web_results
            WHERE contains(url, 'http') AND NOT contains(url, 'doc.') QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1""",
        "web_background": f"SELECT page_id AS pos, substr(trim(regexp_replace(text, '{_WS_V}+', ' ', 'g')), 1, 1500) AS background FROM web_results",
        "segment_text": f"WITH RECURSIVE {_SEGMENTS} SELECT pos, i, segment FROM sg",
        "recall_sentences": f"WITH RECURSIVE {_SENTENCES} SELECT sentence, min(pos) AS pos FROM st WHERE length(sentence) >= 20 GROUP BY sentence",
        "recall_keywords": f"""WITH RECURSIVE {_SENTENCES}, t AS (SELECT title FROM ({_TITLES}) ORDER BY score DESC, pos LIMIT 3),
            c AS (SELECT page_id FROM web_results w WHERE EXISTS (SELECT 1 FROM t WHERE t.title IS NOT DISTINCT FROM w.title)),
            f AS (SELECT sentence, min({{'pos': pos, 'i': i}}) AS place FROM st WHERE length(sentence) >= 20 AND pos IN (SELECT page_id FROM c) GROUP BY sentence),
            b AS (SELECT sentence, place FROM f ORDER BY place LIMIT 6)
            SELECT coalesce(string_agg(sentence, chr(10) ORDER BY place), '') AS background FROM b""",
        "keywords_tfidf": r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM documents),
            tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
            n AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
            s AS (SELECT doc_id, word, round(tf / n * ln((SELECT count(*) FROM documents) / df), 6) AS weight FROM tf JOIN df USING (word) JOIN n USING (doc_id))
            SELECT doc_id, word, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) AS rk FROM s QUALIFY rk <= 5""",
        "title_score": _TITLES,
        "title_top": f"SELECT * FROM ({_TITLES}) ORDER BY score DESC, pos LIMIT 3",
        "history_prompt": """SELECT conv_id, string_agg('用户：' || coalesce(event_type, '') || chr(10) || '助手：' || coalesce(props, '') || chr(10), '' ORDER BY event_id) AS history
            FROM (SELECT user_id AS conv_id, * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3) GROUP BY conv_id""",
        "context_blocks": f"SELECT source, {_blocks_sql()} FROM ({_RANKED.format(5)}) GROUP BY source",
        "previews": f"SELECT source, rk, substr(title, 1, 12) || '...' AS preview FROM ({_RANKED.format(3)})",
        "hit_summary": f"""SELECT source, string_agg('**检索块 ' || rk || '**: ' || title, chr(10) || chr(10) ORDER BY rk) FILTER (rk <= 10) AS summary,
            greatest(count(*) - 10, 0) AS n_more FROM ({_RANKED.format(1 << 40)}) GROUP BY source""",
        "reasoning_parse": """SELECT event_id, CASE WHEN event_id % 6 <= 2 THEN event_type ELSE '无法分析检索到的信息。' END AS analysis,
            CASE WHEN event_id % 6 < 2 THEN user_id || '|b' WHEN event_id % 6 = 2 THEN '' ELSE '无法识别缺失信息' END AS missing,
            CASE WHEN event_id % 6 < 2 THEN 'q' || user_id ELSE '' END AS follow_up, CASE WHEN event_id % 6 = 1 THEN '是' ELSE '否' END AS sufficient FROM events""",
        "answer_route": f"""SELECT CASE WHEN web AND local THEN 'merge' WHEN local THEN 'local' WHEN web THEN 'web' ELSE 'none' END AS route, count(*) AS n FROM
            (SELECT query_text, max(coalesce(length(regexp_replace(text, '{_WS_V}+', '', 'g')) > 0, false)) AS web, max(title IS NOT NULL AND page_id % 3 = 0) AS local FROM web_results GROUP BY query_text) GROUP BY 1""",
        "multihop_search": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
            {_hop_sql("h0", "SELECT vec_id AS qid, e FROM v WHERE vec_id % 50 = 0", 5)},
            {_hop_sql("h1", "SELECT qid, e FROM h0 JOIN v ON v.vec_id = h0.item WHERE rk = 2", 3)},
            {_hop_sql("h2", "SELECT qid, e FROM h1 JOIN v ON v.vec_id = h1.item WHERE rk = 2", 3)},
            a AS (SELECT *, 0::BIGINT AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2)
            SELECT qid, item, hop, rk FROM a QUALIFY row_number() OVER (PARTITION BY qid, item ORDER BY hop, rk) = 1""",
    }
