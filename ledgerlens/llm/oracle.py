"""The queries once more as DuckDB SQL, where SQL can express them."""

_LEAF = r"(?:[^\t\n\x0b\f\r ]*[^\t\n\x0b\f\r .!?][\t\x0b\f\r ]+){0,7}[^\t\n\x0b\f\r ]+[\t\x0b\f\r ]*"


def _tree(of: str, name: str) -> str:
    """Common table expressions that give ``name``: paragraphs p, section ends e, section nodes s and root r of texts ``of``."""
    return f"""
    {name}1 AS (SELECT i, list_transform(string_split({of}, chr(10)), lambda x: sha256('p' || x)) AS p FROM texts),
    {name}2 AS (SELECT i, p, list_filter(range(1, len(p) + 1), lambda k: k = len(p) OR p[k] LIKE '0%' OR p[k] = sha256('p')) AS e FROM {name}1),
    {name}3 AS (SELECT i, p, e, list_transform(range(1, len(e) + 1), lambda k: sha256('s' || list_aggregate(
        p[CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END : e[k]], 'string_agg', ''))) AS s FROM {name}2),
    {name} AS (SELECT i, p, e, s, sha256('r' || list_aggregate(s, 'string_agg', '')) AS r,
        list_distinct(regexp_extract_all({of}, '{_LEAF}')) AS l FROM {name}3 JOIN texts USING (i))"""


_NEAR = """CASE WHEN {a}.r = {b}.r THEN 1.0::DOUBLE WHEN len({a}.l) + len({b}.l) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect({a}.l, {b}.l)) / (len({a}.l) + len({b}.l)) END"""

OP1 = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS i FROM documents
), following AS (
    SELECT a.i, a.doc_id, a.text, b.text AS next_text, length(a.text) AS n
    FROM docs a JOIN docs b ON b.i = CASE WHEN a.i = (SELECT max(i) FROM docs) THEN 1 ELSE a.i + 1 END
), texts AS (
    SELECT i, doc_id, n, text, next_text, substring(text, 1, n - n // 2) || substring(next_text, 1, n // 2) AS edited FROM following
), {_tree("text", "t")}, {_tree("edited", "e")}, {_tree("next_text", "x")},
heads AS (
    SELECT i, coalesce(list_position(list_transform(list_zip(e.s, t.s), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false), 0) - 1 AS head,
        coalesce(list_position(list_transform(list_zip(list_reverse(e.s), list_reverse(t.s)), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false), 0) - 1 AS foot
    FROM t JOIN e USING (i)
), places AS (
    SELECT i, CASE WHEN head = 0 THEN 0 ELSE e.e[head] END AS low, least(foot, least(len(e.s), len(t.s)) - head) AS tail
    FROM heads JOIN e USING (i) JOIN t USING (i)
), ranges AS (
    SELECT i, low, coalesce(e.e[len(e.e) - tail], 0) AS high, coalesce(t.e[len(t.e) - tail], 0) AS old_high
    FROM places JOIN e USING (i) JOIN t USING (i)
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, t.r AS fingerprint, e.r AS edited_fingerprint,
    {_NEAR.format(a="t", b="e")} AS near_edited, {_NEAR.format(a="t", b="x")} AS near_next,
    len(t.s)::INTEGER AS n_sections, len(t.p)::INTEGER AS n_paragraphs,
    CASE WHEN t.r <> e.r THEN low END::INTEGER AS changed_from, CASE WHEN t.r <> e.r THEN high END::INTEGER AS changed_to,
    CASE WHEN t.r <> e.r THEN len(list_filter(list_distinct(e.p[low + 1 : high]),
        lambda v: NOT list_contains(t.p[low + 1 : old_high], v))) END::INTEGER AS changed_paragraphs
FROM texts JOIN t USING (i) JOIN e USING (i) JOIN x USING (i) JOIN ranges USING (i)
"""

OP2 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS i, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
    SELECT i, unnest(range(1, len(lines) + 1)) AS place, unnest(lines) AS line FROM docs
), keys AS (
    SELECT i, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
    SELECT k FROM keys WHERE k <> '' GROUP BY k HAVING count(DISTINCT i) >= 10
), kept AS (
    SELECT i, count(*) AS n_lines, count(f.k) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE f.k IS NULL), '') AS text
    FROM keys LEFT JOIN frequent f USING (k) GROUP BY i
)
SELECT doc_id, n_lines, n_dropped, sha256(kept.text) AS kept_sha256 FROM docs JOIN kept USING (i)
"""

OP11 = r"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), least AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
), degrees AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN degrees USING (vec_id)
"""


def _terms(table: str) -> str:
    """Terms of a text column, as a list."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT *, regexp_extract_all(coalesce({lower}, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM {table}"


OP12 = f"""
WITH docs AS (
    SELECT doc_id, len(terms) AS n, terms FROM ({_terms("documents")})
), whole AS (
    SELECT count(*) FILTER (WHERE n > 0) AS big_n, sum(n)::BIGINT AS words FROM docs
), wanted AS (
    SELECT DISTINCT item_id, unnest(terms) AS term FROM ({_terms("benchmark")})
), counts AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, whole GROUP BY term
), scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // words))))::BIGINT AS score
    FROM wanted JOIN counts USING (term) JOIN weights USING (term), whole GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

ORACLES = {"op1_fingerprints": OP1, "op2_line_dedup": OP2, "op11_vector_dedup": OP11, "op12_ranked_search": OP12}
