"""Queries of lexical, vector and hybrid retrieval.

Query sets are the rows whose id is divisible by 100 (vectors), or all rows of query_specs and eval_items, against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import fusion as U
from papyra.operators import lexical as L
from papyra.operators.latest import latest_rows
from papyra.operators.vector import vector_topk
from papyra.plans.registry import query, table
from papyra.plans.text_queries import _SENTENCES
from papyra.storage import small_side, stage


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _asked(spark, d):
    return _vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("qid"), "v", "label")


_SIM = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_COS = f"round({_SIM} / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"


def _nearest(score: str, where: str = "", k: int = 10) -> str:
    return f"SELECT a.vec_id AS qid, b.vec_id AS id, {score} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {score} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {where} WHERE a.vec_id % 100 = 0 QUALIFY rank <= {k}"


@query("vec_topk_cosine", _nearest(_COS))
def vec_topk_cosine(spark, d):
    return vector_topk(_vectors(spark, d), _asked(spark, d), 10)


@query("vec_topk_dot", _nearest(f"round({_SIM}, 6)"))
def vec_topk_dot(spark, d):
    return vector_topk(_vectors(spark, d), _asked(spark, d), 10, "dot")


@query("vec_topk_l2", _nearest("round(-(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) + list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) - 2 * " + _SIM + "), 6)"))
def vec_topk_l2(spark, d):
    return vector_topk(_vectors(spark, d), _asked(spark, d), 10, "l2")


@query("vec_topk_filtered", _nearest(_COS, "AND b.label < 5"))
def vec_topk_filtered(spark, d):
    return vector_topk(_vectors(spark, d).where("label < 5"), _asked(spark, d), 10)


@query("agg_best_child", f"""
WITH n AS ({_nearest(_COS, k=200)}), p AS (SELECT n.qid, e.label AS parent, n.id, n.score FROM n JOIN embeddings e ON e.vec_id = n.id)
SELECT qid, parent, id AS child, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, parent ORDER BY score DESC, id) AS r FROM p) WHERE r = 1 QUALIFY rank <= 5""")
def agg_best_child(spark, d):
    """Parents by their best child: of each query's 200 nearest vectors the best of each label."""
    near = vector_topk(_vectors(spark, d), _asked(spark, d), 200).drop("rank").join(_vectors(spark, d).select("id", F.col("label").alias("parent")), "id")
    best = near.groupBy("qid", "parent").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b")).select("qid", "parent", F.col("b.id").alias("child"), (-F.col("b.s")).alias("score"))
    return L.top_per_query(best, 5, F.desc("score"), "parent")


_STOPS = "['" + "','".join(T.ENGLISH_STOP_WORDS) + "']"


def _analyzed(c: str) -> str:
    """The SQL of ``functions.text.analyzed``."""
    w = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND w LIKE '%ses' THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"
    return f"list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: NOT list_contains({_STOPS}, w)), lambda w: {w})"


def _bm(k1: float = 1.2) -> str:
    return f"""
WITH d AS (SELECT doc_id AS id, {_analyzed('text')} AS t FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
q AS (SELECT DISTINCT query_id AS qid, unnest({_analyzed('raw')}) AS term FROM query_specs),
p AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM d),
tf AS (SELECT id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
h AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS matched FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM h)
"""


def _questions(spark, d):
    return table(spark, d, "query_specs").select(F.col("query_id").alias("qid"), F.col("raw").alias("text"))


def _hits(spark, d, k: int, k1: float = 1.2):
    return L.bm25(_docs(spark, d), L.query_terms(_questions(spark, d)), k, k1)


@query("lex_analyzer", f"WITH t AS (SELECT id, ingested_at, {_analyzed('abstract')} AS t FROM papers WHERE abstract IS NOT NULL) SELECT id, ingested_at, len(t) AS n, list_sort(list_distinct(t)) AS terms FROM t")
def lex_analyzer(spark, d):
    t = T.analyzed(F.col("abstract"))
    return table(spark, d, "papers").where("abstract is not null").select("id", "ingested_at", F.size(t).alias("n"), F.array_sort(F.array_distinct(t)).alias("terms"))


@query("lex_bm25_or", _bm() + "SELECT qid, id, score, matched, rank FROM r WHERE rank <= 50")
def lex_bm25_or(spark, d):
    return _hits(spark, d, 50)


@query("lex_bm25_preset", _bm(1.4) + "SELECT qid, id, score, matched, rank FROM r WHERE rank <= 10")
def lex_bm25_preset(spark, d):
    return _hits(spark, d, 10, 1.4)


_BOOSTED = f"SELECT DISTINCT query_id AS qid, unnest({_analyzed('array_to_string(keyword_boosted, chr(32))')}) AS term FROM query_specs"
_MUST = f"""
WITH q AS ({_BOOSTED}),
m AS (SELECT qid, count(*) AS wanted FROM q GROUP BY qid),
p AS (SELECT DISTINCT doc_id AS id, unnest({_analyzed('text')}) AS term FROM documents WHERE text IS NOT NULL)
"""


def _boosted(spark, d):
    return L.query_terms(table(spark, d, "query_specs").select(F.col("query_id").alias("qid"), F.array_join("keyword_boosted", " ").alias("text")))


@query("lex_and", _MUST + "SELECT qid, id, count(*) AS matched FROM q JOIN p USING (term) JOIN m USING (qid) GROUP BY qid, id, wanted HAVING count(*) = wanted")
def lex_and(spark, d):
    terms = _boosted(spark, d)
    return L.text_index(_docs(spark, d), terms).every(terms).select("qid", "id", "matched")


@query("lex_entry", rf"""
WITH s AS (SELECT query_id AS qid, coalesce(nullif(array_to_string(list_filter(regexp_extract_all(lower(raw), '[a-z0-9'']+'), lambda x: NOT list_contains({"['" + "','".join(T.STOP_WORDS) + "']"}, x)), ' '), ''), raw) AS text FROM query_specs),
q AS (SELECT DISTINCT qid, unnest({_analyzed('text')}) AS term FROM s), m AS (SELECT qid, count(*) AS wanted FROM q GROUP BY qid),
c AS (SELECT DISTINCT ON (id) id, text, {_analyzed('text')} AS t FROM chunks WHERE text IS NOT NULL ORDER BY id, ingested_at DESC),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM c),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
h AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN m USING (qid) JOIN tf USING (term) JOIN df USING (term), st GROUP BY qid, id, wanted HAVING count(*) = wanted),
r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= 10)
SELECT r.qid, r.rank, c.text AS quote FROM r JOIN c USING (id)""")
def lex_entry(spark, d):
    """Stop words stripped, chunks that hold every word left, the best ten as quotes."""
    from papyra.plans.pipeline import lexical_quotes

    return lexical_quotes(_chunks(spark, d, "text").where("text is not null"), table(spark, d, "query_specs").select(F.col("query_id").alias("qid"), F.col("raw").alias("text")), 10)


@query("lex_terms_set", """
WITH c AS (SELECT DISTINCT ON (id) id, keyword_key FROM chunks ORDER BY id, ingested_at DESC), q AS (SELECT query_id AS qid, list_distinct(keyword_boosted || keyword_regular) AS k FROM query_specs WHERE keyword_boosted IS NOT NULL AND keyword_regular IS NOT NULL),
w AS (SELECT qid, k, unnest(k) AS term FROM q), x AS (SELECT id, unnest(list_distinct(keyword_key)) AS term FROM c)
SELECT qid, id, count(*) AS matched FROM w JOIN x USING (term) GROUP BY qid, id, len(k) HAVING count(*) >= greatest(1, ceil(0.6 * len(k)))""")
def lex_terms_set(spark, d):
    c = latest_rows(table(spark, d, "chunks").select("id", "keyword_key", "ingested_at"), ["id"], "ingested_at").select("id", F.explode(F.array_distinct("keyword_key")).alias("term"))
    k = F.array_distinct(F.concat("keyword_boosted", "keyword_regular"))
    q = table(spark, d, "query_specs").select(F.col("query_id").alias("qid"), F.size(k).alias("n"), F.explode(k).alias("term"))
    return c.join(small_side(q), "term").groupBy("qid", "id", "n").agg(F.count("*").alias("matched")).where(F.col("matched") >= F.greatest(F.lit(1), F.ceil(0.6 * F.col("n")))).drop("n")


# chunks by field: text, shingles of two and three terms, section title, headings, model names
_BOOSTS = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in L.CHUNK_BOOSTS.items()) + "}"
_SHINGLES = "list_concat([t[i] || ' ' || t[i+1] FOR i IN range(1, len(t))], [t[i] || ' ' || t[i+1] || ' ' || t[i+2] FOR i IN range(1, len(t) - 1)])"
_FIELDS = f"""
WITH c AS (SELECT DISTINCT ON (id) id, {_analyzed('text')} AS t, {_analyzed('section_title')} AS s, {_analyzed("array_to_string(headings, ' ')")} AS h, list_transform(model_names, lambda x: lower(x)) AS m, header_score FROM chunks ORDER BY id, ingested_at DESC),
f AS (SELECT id, 'text' AS field, t FROM c UNION ALL SELECT id, 'shingle', {_SHINGLES} FROM c UNION ALL SELECT id, 'section', s FROM c UNION ALL SELECT id, 'headings', h FROM c UNION ALL SELECT id, 'model', m FROM c),
st AS (SELECT field, count(*) AS n, avg(len(t)) AS avgdl FROM f WHERE t IS NOT NULL GROUP BY field),
q0 AS (SELECT query_id AS qid, {_analyzed('raw')} AS t FROM query_specs WHERE raw IS NOT NULL),
q AS (SELECT DISTINCT qid, unnest(list_concat(t, {_SHINGLES})) AS term FROM q0),
tf AS (SELECT field, id, dl, term, count(*) AS tf FROM (SELECT field, id, len(t) AS dl, unnest(t) AS term FROM f) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
idf AS (SELECT field, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df JOIN st USING (field)),
w AS (SELECT field, id, term, {_BOOSTS}[field] * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN idf USING (field, term) JOIN st USING (field)),
sums AS (SELECT qid, id, field, sum(w) AS s, count(*) AS n FROM q JOIN w USING (term) GROUP BY ALL),
best AS (SELECT qid, id, round(max(s) + 0.2::DOUBLE * (sum(s) - max(s)), 6) AS score, sum(n)::BIGINT AS matched FROM sums GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM best)
"""
#: a question's phrase: its last two terms; in-order matches with at most two terms in between
_PHRASE = """,
qp AS (SELECT qid, t[-2] AS a, t[-1] AS b FROM q0 WHERE len(t) >= 2),
ph0 AS (SELECT qid, id, a, b, list_sum([1.0::DOUBLE / coalesce(list_position(t[i+1:i+3], b), 0) FOR i IN range(1, len(t)) IF t[i] = a AND list_contains(t[i+1:i+3], b)]) AS freq FROM qp JOIN c ON list_contains(c.t, a) AND list_contains(c.t, b)),
ph AS (SELECT qid, id, round((x.idf + CASE WHEN a = b THEN 0 ELSE y.idf END) * freq * 2.2::DOUBLE / (freq + 1.2::DOUBLE), 6) AS phrase FROM ph0 JOIN idf x ON x.field = 'text' AND x.term = a JOIN idf y ON y.field = 'text' AND y.term = b WHERE freq > 0)
"""


def _chunks(spark, d, *cols):
    """The latest delivery of each chunk: its id and these columns."""
    return latest_rows(table(spark, d, "chunks").select("id", *cols, "ingested_at"), ["id"], "ingested_at").drop("ingested_at")


def _with_shingles(t):
    return F.concat(t, T.shingles(t, 2), T.shingles(t, 3))


def _field_terms(spark, d):
    q = _questions(spark, d).where("text is not null")
    return q.select("qid", F.explode(F.array_distinct(_with_shingles(T.analyzed(F.col("text"))))).alias("term"))


def _chunk_terms(spark, d):
    """``(id, terms)`` of the chunks' texts, analysed once."""
    return stage(_chunks(spark, d, "text").select("id", T.analyzed(F.col("text")).alias("terms")), "chunk-terms")


def _chunk_fields(spark, d):
    """``(id, text, section, headings, model)``: the terms of the chunks' fields, analysed once."""
    c = _chunks(spark, d, "text", "section_title", "headings", "model_names")
    fields = {"text": T.analyzed(F.col("text")), "section": T.analyzed(F.col("section_title")), "headings": T.analyzed(F.array_join("headings", " ")), "model": F.transform("model_names", F.lower)}
    return stage(c.select("id", *[v.alias(k) for k, v in fields.items()]), "chunk-fields")


def _field_index(chunks, terms):
    """Index of the fields that ``_chunk_fields`` gives."""
    fields = {k: F.col(k) for k in L.CHUNK_BOOSTS if k != "shingle"}
    t = fields["text"]
    fields = {"text": t, "shingle": F.concat(T.shingles(t, 2), T.shingles(t, 3)), **fields}
    return L.LexicalIndex.build(chunks, terms, {k: (v, L.CHUNK_BOOSTS[k]) for k, v in fields.items()})


def _phrases(spark, d):
    q = _questions(spark, d).select("qid", T.analyzed(F.col("text")).alias("t")).where("size(t) >= 2")
    return q.select("qid", F.slice("t", -2, 2).alias("phrase"))


def _phrase_hits(spark, d, chunks, index):
    """As ``lexical.phrase_hits``: the questions' phrases by number, and their scores in the chunks."""
    idf = index.only("text").features.select("term", "idf")
    asked, hits = L.phrase_hits(chunks.select("id", F.col("text").alias("terms")), _phrases(spark, d), idf, 2)
    return asked, stage(hits, "phrase-hits")


@query("lex_best_fields", _FIELDS + "SELECT qid, id, score, matched, rank FROM r WHERE rank <= 50")
def lex_best_fields(spark, d):
    """BM25 in five boosted fields of the chunks: the best field plus 0.2 of the others."""
    terms = _field_terms(spark, d)
    return _field_index(_chunk_fields(spark, d), terms).top(terms, 50, 0.2)


@query("lex_phrase", _FIELDS + _PHRASE + "SELECT qid, id, phrase FROM ph")
def lex_phrase(spark, d):
    docs, phrases = _chunk_terms(spark, d), _phrases(spark, d)
    return L.phrase_scores(docs, phrases, L.inverse_frequencies(docs, phrases.select(F.explode("phrase").alias("term"))), 2)


@query("lex_dis_max", _FIELDS + _PHRASE + """, m AS (SELECT coalesce(best.qid, ph.qid) AS qid, coalesce(best.id, ph.id) AS id, coalesce(score, 0) AS f, coalesce(phrase, 0) AS p FROM best FULL JOIN ph ON best.qid = ph.qid AND best.id = ph.id),
x AS (SELECT qid, id, round(greatest(f, p) + 0.1::DOUBLE * ((f + p) - greatest(f, p)) + 1e-9::DOUBLE, 6) AS score FROM m) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM x QUALIFY rank <= 50""")
def lex_dis_max(spark, d):
    """The better of the fields' score and the phrase's, plus 0.1 of the other."""
    return _dis_max(spark, d, 50).select("qid", "id", "score", "rank")


def _dis_max(spark, d, k):
    terms, chunks = _field_terms(spark, d), _chunk_fields(spark, d)
    index = _field_index(chunks, terms)
    return index.top_with_phrases(terms, *_phrase_hits(spark, d, chunks, index), k, 0.2, 0.1)


@query("lex_function_score", _FIELDS + "SELECT r.qid, r.id, round(r.score + coalesce(header_score, 0), 6) AS score FROM r JOIN c USING (id) WHERE rank <= 50")
def lex_function_score(spark, d):
    """The fifty best chunks by field, their scores raised by the header score."""
    terms = _field_terms(spark, d)
    hits = _field_index(_chunk_fields(spark, d), terms).top(terms, 50, 0.2)
    return L.function_score(hits.join(_chunks(spark, d, "header_score"), "id"), "header_score").select("qid", "id", "score")


@query("lex_rescore", _FIELDS + _PHRASE + """, win AS (SELECT r.qid, r.id, r.score, r.rank, coalesce(ph.phrase, 0) AS phrase FROM r LEFT JOIN ph ON ph.qid = r.qid AND ph.id = r.id WHERE rank <= 250)
SELECT qid, id, round(CASE WHEN rank <= 200 THEN score + 2 * phrase ELSE score END, 6) AS new_score, row_number() OVER (PARTITION BY qid ORDER BY (rank > 200)::INT, CASE WHEN rank <= 200 THEN -round(score + 2 * phrase, 6) ELSE rank END, rank) AS new_rank FROM win""")
def lex_rescore(spark, d):
    """Of 250 hits the first 200 are ordered again by their score plus twice the phrase's."""
    terms, chunks = _field_terms(spark, d), _chunk_fields(spark, d)
    index = _field_index(chunks, terms)
    asked, hits = _phrase_hits(spark, d, chunks, index)
    # the phrase's score is looked up for the hits alone
    top = index.top(terms, 250, 0.2).join(small_side(asked), "qid", "left").join(hits, ["pno", "id"], "left").fillna(0.0, ["phrase"])
    return L.rescored(top, 200, "phrase").select("qid", "id", "new_score", "new_rank")


@query("lex_bool", _bm() + f""", m AS ({_BOOSTED}), n AS (SELECT qid, count(*) AS wanted FROM m GROUP BY qid),
k AS (SELECT m.qid, t.id FROM m JOIN (SELECT DISTINCT id, term FROM p) t USING (term) JOIN n USING (qid) GROUP BY m.qid, t.id, wanted HAVING count(*) = wanted)
SELECT k.qid, k.id, round(1 + coalesce(h.score, 0), 6) AS score FROM k LEFT JOIN h USING (qid, id) JOIN documents d ON d.doc_id = k.id WHERE d.source IS NOT NULL""")
def lex_bool(spark, d):
    """Every boosted keyword must be there (1 point), the question's terms add their score, and the source must be known."""
    must, terms = _boosted(spark, d), L.query_terms(_questions(spark, d))
    # the statistics are those of all documents
    known = table(spark, d, "documents").where("source is not null").select(F.col("doc_id").alias("id"))
    held = L.text_index(_docs(spark, d), must.unionByName(terms)).among(known).every(must, scored=terms)
    rows = held.select("qid", "id", F.lit(1.0).alias("must"), F.nullif("score", F.lit(0.0)).alias("should"))
    return L.bool_query(rows, ["must"], ["should"]).select("qid", "id", "score")


@query("lex_highlight", rf"""
WITH k AS (SELECT DISTINCT ON (query_id, chunk_id) query_id, chunk_id FROM candidates ORDER BY query_id, chunk_id), c AS (SELECT DISTINCT ON (id) id, text FROM chunks ORDER BY id, ingested_at DESC),
q AS (SELECT query_id, array_to_string(list_distinct(list_filter(regexp_extract_all(lower(raw), '[a-z0-9]+'), lambda w: NOT list_contains({_STOPS}, w))), '|') AS p FROM query_specs),
s AS (SELECT query_id, chunk_id, p, unnest({_SENTENCES}) AS s FROM k JOIN c ON c.id = k.chunk_id JOIN q USING (query_id))
SELECT query_id, chunk_id, regexp_replace(s, '(?i)\b(' || p || ')\b', '<em>\1</em>', 'g') AS snippet FROM s WHERE p <> '' AND regexp_matches(s, '(?i)\b(' || p || ')\b')""")
def lex_highlight(spark, d):
    """The sentences of each candidate that hold a word of the question, with these words marked."""
    k = table(spark, d, "candidates").select("query_id", "chunk_id").distinct()
    words = F.array_distinct(F.filter(T.plain_terms(F.col("raw")), lambda w: ~w.isin(T.ENGLISH_STOP_WORDS)))
    q = table(spark, d, "query_specs").select("query_id", words.alias("words"))
    s = k.join(_chunks(spark, d, "text"), F.col("chunk_id") == F.col("id")).join(small_side(q), "query_id").select("query_id", "chunk_id", "words", F.explode(T.sentences(F.col("text"))).alias("s"))
    s = s.withColumn("snippet", L.highlighted(F.col("s"), F.col("words")))
    return s.where("snippet <> s").select("query_id", "chunk_id", "snippet")


@query("lex_fallback", _MUST + """, h AS (SELECT qid, id, count(*)::DOUBLE AS score FROM q JOIN p USING (term) JOIN m USING (qid) GROUP BY qid, id, wanted HAVING count(*) = wanted),
f AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 5)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY id) AS rank FROM h QUALIFY rank <= 5
UNION ALL SELECT query_id, f.id, 0.0::DOUBLE, f.rank FROM query_specs, f WHERE query_id NOT IN (SELECT qid FROM h)""")
def lex_fallback(spark, d):
    """Five documents that hold every boosted keyword; a question without one gets the first five documents."""
    terms = _boosted(spark, d)
    hits = L.text_index(_docs(spark, d), terms).every(terms, first=5).select("qid", "id", F.col("matched").cast("double").alias("score"))
    return L.with_fallback(stage(L.top_per_query(hits, 5, "id"), "lexical-fallback"), _questions(spark, d), _docs(spark, d), 5)


# hybrid: each question's vector is that of the document its number names, where there is one
_HYBRID = _bm() + f""", lx AS (SELECT qid, id, score, rank FROM r WHERE rank <= 40),
v AS (SELECT query_id AS qid, e.vec_id, e.embedding FROM query_specs JOIN embeddings e ON e.vec_id = query_id),
s AS (SELECT a.qid, b.vec_id AS id, {_COS} AS score FROM v a JOIN embeddings b ON a.vec_id <> b.vec_id),
sm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 80),
m AS (SELECT coalesce(lx.qid, sm.qid) AS qid, coalesce(lx.id, sm.id) AS id, lx.score AS lexical_score, lx.rank AS lexical_rank, sm.score AS semantic_score, sm.rank AS semantic_rank FROM lx FULL JOIN sm ON lx.qid = sm.qid AND lx.id = sm.id)
"""


def _two_lists(spark, d):
    lexical = stage(_hits(spark, d, 40).select("qid", "id", "score", "rank"), "lexical-hits")
    asked = _questions(spark, d).select("qid").join(_vectors(spark, d).select(F.col("id").alias("qid"), "v"), "qid")
    return lexical, vector_topk(_vectors(spark, d), asked, 80)


@query("r1_rrf_hybrid", _HYBRID + ", f AS (SELECT qid, id, round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0), 9) AS fused FROM m) SELECT qid, id, fused, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id) AS rank FROM f QUALIFY rank <= 8")
def r1_rrf_hybrid(spark, d):
    """BM25 and vector hits of every question, fused by reciprocal rank."""
    lexical, semantic = _two_lists(spark, d)
    hits = lexical.select("qid", "id", F.lit("lexical").alias("list"), "rank").unionByName(semantic.select("qid", "id", F.lit("semantic").alias("list"), "rank"))
    return L.top_per_query(U.rrf(hits), 8, F.desc("fused"), "id")


@query("join_hits_full_outer", _HYBRID + "SELECT * FROM m")
def join_hits_full_outer(spark, d):
    return U.merged(*_two_lists(spark, d))


@query("fuse_zscore", _HYBRID + """, z AS (SELECT *, avg(lexical_score) OVER w AS lm, CASE WHEN count(lexical_score) OVER w < 2 THEN 1 ELSE coalesce(nullif(stddev_samp(lexical_score) OVER w, 0), 1) END AS ls,
 avg(semantic_score) OVER w AS sm, CASE WHEN count(semantic_score) OVER w < 2 THEN 1 ELSE coalesce(nullif(stddev_samp(semantic_score) OVER w, 0), 1) END AS ss FROM m WINDOW w AS (PARTITION BY qid))
SELECT qid, id, round(0.5::DOUBLE * ((coalesce(lexical_score, 0) - coalesce(lm, 0)) / ls) + 0.5::DOUBLE * coalesce((semantic_score - sm) / ss, 0), 6) AS fused FROM z""")
def fuse_zscore(spark, d):
    return U.zscore_fused(U.merged(*_two_lists(spark, d))).select("qid", "id", "fused")


@query("fuse_max_normalised", _HYBRID + "SELECT qid, id, round(coalesce(lexical_score / nullif(max(lexical_score) OVER w, 0), 0) + coalesce(semantic_score / nullif(max(semantic_score) OVER w, 0), 0), 6) AS fused FROM m WINDOW w AS (PARTITION BY qid)")
def fuse_max_normalised(spark, d):
    return U.max_normalised(U.merged(*_two_lists(spark, d))).select("qid", "id", "fused")


@query("fuse_sentence_hybrid", _HYBRID + "SELECT qid, id, round(coalesce(lexical_score, 0) + coalesce(semantic_score, 0), 6) AS score FROM m")
def fuse_sentence_hybrid(spark, d):
    m = U.merged(*_two_lists(spark, d))
    return m.select("qid", "id", F.round(F.coalesce("lexical_score", F.lit(0.0)) + F.coalesce("semantic_score", F.lit(0.0)), 6).alias("score"))


@query("fuse_section_bias", f"""
WITH c AS (SELECT DISTINCT ON (id) id, section_title, headings FROM chunks ORDER BY id, ingested_at DESC), k AS (SELECT DISTINCT ON (query_id, chunk_id) * FROM candidates ORDER BY query_id, chunk_id, logged_at DESC)
SELECT query_id AS qid, chunk_id AS id, floor(1000000 * fused_score * CASE WHEN regexp_matches(lower(concat_ws(' ', section_title, array_to_string(headings, ' '))), '{"|".join(T.SECTION_PENALTIES)}') THEN 0.15::DOUBLE
  WHEN regexp_matches(lower(concat_ws(' ', section_title, array_to_string(headings, ' '))), '{"|".join(T.SECTION_BONUSES)}') THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END + 0.5) / 1000000 AS biased FROM k JOIN c ON c.id = k.chunk_id""")
def fuse_section_bias(spark, d):
    c = latest_rows(table(spark, d, "chunks").select("id", "section_title", "headings", "ingested_at"), ["id"], "ingested_at").drop("ingested_at")
    k = latest_rows(table(spark, d, "candidates").select("query_id", "chunk_id", "fused_score", "logged_at"), ["query_id", "chunk_id"], "logged_at")
    j = k.join(c, F.col("chunk_id") == F.col("id"))
    return j.select(F.col("query_id").alias("qid"), "id", (F.floor(1000000 * F.col("fused_score") * T.section_bias(F.col("section_title"), F.array_join("headings", " ")) + 0.5) / 1000000).alias("biased"))


@query("fuse_mmr", r"""
WITH RECURSIVE k AS (SELECT DISTINCT ON (query_id, chunk_id) * FROM candidates ORDER BY query_id, chunk_id, logged_at DESC), c AS (SELECT DISTINCT ON (id) id, text FROM chunks ORDER BY id, ingested_at DESC),
t AS (SELECT query_id AS qid, chunk_id AS id, fused_score AS f FROM k WHERE fused_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, chunk_id) <= 50),
j AS (SELECT qid, t.id, f, list_distinct(regexp_extract_all(lower(c.text), '[^\s]+')) AS w FROM t JOIN c ON c.id = t.id),
g AS (SELECT qid, list(id ORDER BY f DESC, id) AS ids, list(f ORDER BY f DESC, id) AS fs, list(coalesce(w, []) ORDER BY f DESC, id) AS ws FROM j GROUP BY qid),
r AS (SELECT qid, ids, fs, ws, [0.0::DOUBLE FOR x IN ids] AS worst, []::INT[] AS taken, 0 AS place, 0 AS pick FROM g
 UNION ALL SELECT qid, ids, fs, ws, [CASE WHEN len(ws[p]) > 0 AND len(ws[i]) > 0 THEN greatest(worst[i], len(list_intersect(ws[p], ws[i]))::DOUBLE / len(list_distinct(ws[p] || ws[i]))) ELSE worst[i] END FOR i IN range(1, len(ids) + 1)], list_append(taken, p), place + 1, p
  FROM (SELECT *, list_position(v, list_max(v))::INT AS p FROM (SELECT *, [CASE WHEN list_contains(taken, i::INT) THEN -1e18::DOUBLE ELSE 0.3::DOUBLE * fs[i] - 0.7::DOUBLE * worst[i] END FOR i IN range(1, len(ids) + 1)] AS v FROM r WHERE place < len(ids) AND place < 50)))
SELECT qid, ids[pick] AS id, fs[pick] AS fused, place FROM r WHERE place > 0""")
def fuse_mmr(spark, d):
    k = latest_rows(table(spark, d, "candidates").select("query_id", "chunk_id", "fused_score", "logged_at"), ["query_id", "chunk_id"], "logged_at").where("fused_score is not null")
    c = latest_rows(table(spark, d, "chunks").select("id", "text", "ingested_at"), ["id"], "ingested_at")
    top = L.top_per_query(k.select(F.col("query_id").alias("qid"), F.col("chunk_id").alias("id"), F.col("fused_score").alias("score")), 50)
    j = top.join(c, "id").select("qid", "id", F.col("score").alias("fused"), F.array_distinct(T.tokens(F.lower("text"))).alias("tokens"))
    return U.diversified(j, "string")
