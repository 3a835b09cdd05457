"""SQL that DuckDB can run on the same tables, for the queries that SQL can express."""

_LETTERS = r"regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')"


def _runs(table: str, key: str, k: int) -> str:
    """Every run of k letters and digits of each text, with its place from 1."""
    return f"""SELECT {key}, t, i, substr(t, i, {k}) AS g
        FROM (SELECT {key}, {_LETTERS} AS t FROM {table}), unnest(generate_series(1, length(t) - {k - 1})) AS u(i) WHERE length(t) >= {k}"""


def _letters(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '', 'g')"


# Fixed value: the name of a field of a flat register record, with its separator.
_NAME = r"""^\s*["''“”]?([\p{L}_][\p{L}\p{N}_\-]*(?: [\p{L}_\-]+)?)["''“”]?\s*[:：=＝]"""

#: k(pos, batch_no, id, chunk, t, k): rows with 20 letters and digits, their letters, and what copies have in common.
_KEYED = rf"""r AS (SELECT pos, batch_no, id, chunk, {_letters("chunk")} AS t, trim(chunk, E' \t\n\r') AS body FROM semantic_chunk_output),
    u AS (SELECT * FROM r WHERE length(t) >= 20),
    j AS (SELECT pos, json_keys(body) AS names, body FROM u WHERE body[1] = '{{' AND body[-1] = '}}' AND TRY_CAST(body AS JSON) IS NOT NULL),
    jf AS (SELECT pos, list_sort(list_distinct(list_transform(names, lambda n: {_letters("n")} || chr(31) || {_letters("json_extract_string(body, '$.\"' || n || '\"')")}))) AS fields
        FROM j WHERE len(names) > 0),
    p AS (SELECT pos, unnest(regexp_split_to_array(trim(body, '{{}}｛｝'), '[;；|｜\r\n]+')) AS part FROM u
        WHERE pos NOT IN (SELECT pos FROM jf) AND regexp_matches(ltrim(body, '{{｛'), '{_NAME}')),
    q AS (SELECT pos, regexp_matches(part, '{_NAME}') AS is_field, {_letters("part")} <> '' AS has_letters,
        {_letters(f"regexp_extract(part, '{_NAME}', 1)")} || chr(31) || {_letters(f"regexp_replace(part, '{_NAME}', '')")} AS f FROM p),
    pf AS (SELECT pos, list_sort(list(DISTINCT f) FILTER (is_field)) AS fields FROM q GROUP BY pos
        HAVING count(*) FILTER (is_field) > 1 AND count(*) FILTER (NOT is_field AND has_letters) = 0),
    k AS (SELECT u.pos, batch_no, id, chunk, t, coalesce('r' || array_to_string(coalesce(jf.fields, pf.fields), chr(30)), 't' || t) AS k
        FROM u LEFT JOIN jf USING (pos) LEFT JOIN pf USING (pos))"""

#: y(ta, tb): unlike texts of which at least 70 % of the distinct runs of 8 are common, one way round.
_SIMILAR = """x AS (SELECT t, min(pos) AS pos, length(t) AS n FROM k GROUP BY t),
    s AS (SELECT DISTINCT x.pos AS i, substr(t, g, 8) AS s FROM x, unnest(generate_series(1, n - 7)) AS v(g)),
    c AS (SELECT i, count(*) AS c FROM s GROUP BY i),
    m AS (SELECT a.i AS a, b.i AS b, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s AND a.i < b.i GROUP BY 1, 2),
    e AS (SELECT a, b FROM m JOIN c p ON p.i = a JOIN c q ON q.i = b WHERE n_both >= 0.7 * (p.c + q.c - n_both)),
    y AS (SELECT p.t AS ta, q.t AS tb FROM e JOIN x p ON p.pos = a JOIN x q ON q.pos = b)"""

SQL: dict[str, str] = {
    "p3_found": f"WITH {_KEYED} SELECT min(pos) OVER (PARTITION BY k) AS first_pos, pos FROM k QUALIFY pos <> first_pos",
    "p3_collapse": f"""WITH {_KEYED}, g AS (SELECT k, min(pos) AS first_pos, count(*) AS n_copies FROM k GROUP BY k)
        SELECT first_pos, n_copies, id, chunk FROM g JOIN k ON pos = first_pos""",
    "p4_found": f"""WITH {_KEYED}, {_SIMILAR}
        SELECT least(a.pos, b.pos) AS pos_a, greatest(a.pos, b.pos) AS pos_b FROM y JOIN k a ON a.t = ta JOIN k b ON b.t = tb WHERE a.k <> b.k""",
    "p6_found": f"""WITH {_KEYED}, {_SIMILAR}, z AS (SELECT ta, tb FROM y UNION ALL SELECT tb, ta FROM y),
        h AS (SELECT a.pos, b.pos AS other FROM k a JOIN k b ON a.k = b.k AND b.batch_no < a.batch_no
            UNION ALL SELECT a.pos, b.pos FROM k a JOIN z ON a.t = ta JOIN k b ON b.t = tb AND b.batch_no < a.batch_no)
        SELECT min(other) AS match_pos, pos FROM h GROUP BY pos""",
    "p10_shares": f"""WITH r AS (SELECT doc_id, t, i FROM ({_runs("documents", "doc_id", 20)}) QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1),
        s AS (SELECT doc_id, length(t) AS n, least(20, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 20)) AS c FROM r),
        f AS (SELECT doc_id, sum(c) / max(n) AS share FROM s GROUP BY doc_id)
        SELECT doc_id, CASE WHEN text IS NOT NULL THEN round(coalesce(share, 0), 6) END AS repeated_share FROM documents LEFT JOIN f USING (doc_id)""",
    "p5_found": """WITH v AS (SELECT id, vector::DOUBLE[] AS e FROM semantic_chunk_vector WHERE id IS NOT NULL AND len(vector) = 64
            AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY vec_no) = 1),
        n AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id
            QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) <= 5)
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM n""",
    "p7_found": "SELECT pos FROM semantic_chunk_output WHERE length(chunk) > 2000",
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({_runs('documents', 'doc_id', 60)}) d JOIN ({_runs('eval_items', 'item_id', 60)}) e USING (g)",
    "p8_items": f"""SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc_id FROM
        (SELECT DISTINCT doc_id, item_id FROM ({_runs("documents", "doc_id", 60)}) d JOIN ({_runs("eval_items", "item_id", 60)}) e USING (g)) GROUP BY item_id""",
    "p10_found": f"""WITH r AS (SELECT doc_id, t, i FROM ({_runs("documents", "doc_id", 20)}) QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1),
        s AS (SELECT doc_id, length(t) AS n, least(20, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 20)) AS c FROM r)
        SELECT doc_id FROM s GROUP BY doc_id HAVING sum(c) / max(n) >= 0.3""",
}
