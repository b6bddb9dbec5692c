"""Queries of chunking operators, over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import chunking as C
from papyra.plans.registry import query, table
from papyra.plans.text_queries import _SENTENCES


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null")


@query("chunk_token_windows", r"""
WITH t AS (SELECT doc_id AS id, regexp_extract_all(text, '[^\s]+') AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT id, t, len(t) AS n, unnest(range(0, greatest(0, ceil((len(t) - 512) / 384.0))::INT + 1)) AS chunk FROM t WHERE len(t) > 0)
SELECT id, chunk::INT AS chunk, (chunk * 384)::INT AS token_start, least(chunk * 384 + 512, n)::INT AS token_end, array_to_string(t[chunk * 384 + 1 : chunk * 384 + 512], ' ') AS text FROM w WHERE chunk = 0 OR n - chunk * 384 >= 40""")
def chunk_token_windows(spark, d):
    return C.token_windows(_docs(spark, d))


def _groups(size: int):
    @query(f"chunk_sentences_{size}", f"""
WITH s AS (SELECT doc_id AS id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL),
g AS (SELECT id, s, unnest(range(0, ceil(len(s) / {size}.0)::INT)) AS chunk FROM s WHERE len(s) > 0)
SELECT id, chunk::INT AS chunk, (chunk * {size})::INT AS sent_start, least(chunk * {size} + {size}, len(s))::INT AS sent_end, array_to_string(s[chunk * {size} + 1 : chunk * {size} + {size}], ' ') AS text FROM g""")
    def run(spark, d):
        return C.sentence_groups(_docs(spark, d), size)


for _n in (1, 3, 4):
    _groups(_n)


@query("chunk_balanced_parts", f"""
WITH s AS (SELECT doc_id AS id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL),
e AS (SELECT id, unnest(range(len(s))) AS pos, unnest(s) AS x FROM s),
n AS (SELECT id, pos, x, ntile(3) OVER (PARTITION BY id ORDER BY pos) - 1 AS part FROM e)
SELECT id, part::INT AS part, min(pos)::INT AS sent_start, (max(pos) + 1)::INT AS sent_end, string_agg(x, ' ' ORDER BY pos) AS text FROM n GROUP BY id, part""")
def chunk_balanced_parts(spark, d):
    return C.balanced_parts(_docs(spark, d), 3)


def _stub_probabilities(texts: list[str]) -> list[float]:
    """A stand-in for a language model's end-of-unit probability."""
    return [len(t) % 101 / 101 for t in texts]


_PARENTS = f"""
WITH RECURSIVE d AS (SELECT doc_id AS id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL),
w AS (SELECT id, s, [greatest(1, len(regexp_extract_all(x, '[^\\s\\p{{Z}}]+'))) FOR x IN s] AS wc FROM d WHERE len(s) > 0),
r AS (SELECT id, s, wc, 0 AS parent, 0 AS fr, 0 AS cut, NULL::DOUBLE AS p FROM w
 UNION ALL SELECT id, s, wc, parent + 1, cut, cut + b.k, b.p FROM (SELECT id, s, wc, parent, cut, list_max([{{'p': length(array_to_string(s[cut + 1 : cut + k], ' ')) % 101 / 101::DOUBLE, 'k': k}} FOR k IN range(1, n + 1)]) AS b
  FROM (SELECT *, [k FOR k IN range(1, 31) IF cut + k <= len(s) AND (list_sum(wc[cut + 1 : cut + k]) >= 300 OR k = 30 OR cut + k = len(s))][1] AS n FROM r WHERE cut < len(s))))
"""


@query("chunk_scored_parents", _PARENTS + "SELECT id, (parent - 1)::INT AS parent, fr::INT AS sent_start, cut::INT AS sent_end, array_to_string(s[fr + 1 : cut], ' ') AS text, p AS eos_probability FROM r WHERE parent > 0")
def chunk_scored_parents(spark, d):
    return C.scored_parents(_docs(spark, d), _stub_probabilities)
