"""Queries of query understanding, record projections, sorting and text functions that work on a question or a hit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions import records as R
from papyra.functions import text as T
from papyra.models import OverlapScorer, cross_scored
from papyra.operators import chunking as C
from papyra.operators import fusion as U
from papyra.operators import lexical as L
from papyra.operators import query_spec as Q
from papyra.operators.ivf import approximate_topk
from papyra.operators.latest import latest_rows
from papyra.operators.vector import dot, l2_normalised, vector_topk
from papyra.plans import pipeline as P
from papyra.plans.registry import query, table
from papyra.plans.text_queries import _SENTENCES
from papyra.storage import small_side

_S = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_STOPS = "['" + "','".join(T.STOP_WORDS) + "']"
_LATEST_PAPERS = "SELECT DISTINCT ON (id) * FROM papers ORDER BY id, ingested_at DESC"
_LATEST_CHUNKS = "SELECT DISTINCT ON (id) * FROM chunks ORDER BY id, ingested_at DESC"
_LOGGED = "SELECT DISTINCT ON (query_id, chunk_id) * FROM candidates ORDER BY query_id, chunk_id, logged_at DESC"


def _papers(spark, d, *cols):
    return latest_rows(table(spark, d, "papers").select("id", *cols, "ingested_at"), ["id"], "ingested_at").drop("ingested_at")


def _chunks(spark, d, *cols):
    return latest_rows(table(spark, d, "chunks").select("id", *cols, "ingested_at"), ["id"], "ingested_at").drop("ingested_at")


def _logged(spark, d, *cols):
    return latest_rows(table(spark, d, "candidates").select("query_id", "chunk_id", *cols, "logged_at"), ["query_id", "chunk_id"], "logged_at").drop("logged_at")


def _specs(spark, d):
    return table(spark, d, "query_specs")


# ---- text functions ----
@query("fn_token_spans", r"""
WITH t AS (SELECT id, regexp_extract_all(text, '[^\s]+') AS t, regexp_split_to_array(text, '[^\s]+') AS g FROM (SELECT DISTINCT ON (id) id, text FROM chunks WHERE text IS NOT NULL ORDER BY id, ingested_at DESC)),
u AS (SELECT id, unnest(range(len(t))) AS pos, unnest(t) AS token, unnest(g[1:len(t)]) AS gap FROM t),
o AS (SELECT id, pos, token, sum(length(gap) + length(token)) OVER (PARTITION BY id ORDER BY pos) AS e FROM u)
SELECT id, pos::INT AS pos, token, (e - length(token))::INT AS start, e::INT AS "end" FROM o""")
def fn_token_spans(spark, d):
    c = latest_rows(table(spark, d, "chunks").where("text is not null").select("id", "text", "ingested_at"), ["id"], "ingested_at")
    return c.select("id", F.posexplode(T.token_spans(F.col("text"))).alias("pos", "s")).select("id", "pos", "s.token", "s.start", "s.end")


@query("fn_question_tokens", "SELECT query_id, regexp_extract_all(lower(raw), '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*') AS tokens FROM query_specs WHERE raw IS NOT NULL")
def fn_question_tokens(spark, d):
    return _specs(spark, d).where("raw is not null").select("query_id", T.question_tokens(F.col("raw")).alias("tokens"))


_LEMMA = """CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND w LIKE '%ses' THEN w[:-3] WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-5]
            WHEN length(w) > 4 AND w LIKE '%ed' THEN w[:-4] WHEN length(w) > 4 AND w LIKE '%ly' THEN w[:-3] WHEN length(w) > 4 AND w LIKE '%er' THEN w[:-3]
            WHEN length(w) > 5 AND w LIKE '%est' THEN w[:-4] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"""


def _lemmas(c: str) -> str:
    return rf"list_transform(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9\-]+'), lambda w: {_LEMMA})"


@query("fn_normal_terms", f"SELECT query_id, {_lemmas('raw')} AS lemmas, regexp_extract_all(lower(raw), '[a-z0-9][a-z0-9\\-]+') AS terms FROM query_specs WHERE raw IS NOT NULL")
def fn_normal_terms(spark, d):
    return _specs(spark, d).where("raw is not null").select("query_id", T.normalised_terms(F.col("raw")).alias("lemmas"), T.normalised_terms(F.col("raw"), False).alias("terms"))


@query("fn_heading_level", r"SELECT section_title, any_value(CASE WHEN regexp_matches(section_title, '^[0-9]+(\.[0-9]+)*\s') THEN length(regexp_extract(section_title, '^([0-9]+(\.[0-9]+)*)\s', 1)) - length(replace(regexp_extract(section_title, '^([0-9]+(\.[0-9]+)*)\s', 1), '.', '')) + 1 ELSE 1 END)::INT AS level FROM chunks WHERE section_title IS NOT NULL GROUP BY section_title")
def fn_heading_level(spark, d):
    return table(spark, d, "chunks").where("section_title is not null").select("section_title", T.heading_level(F.col("section_title")).alias("level")).distinct()


@query("fn_token_clean", r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\s]+')) AS w FROM documents), s AS (SELECT w, regexp_replace(w, '^[\s"''.,:;()\[\]{}]+|[\s"''.,:;()\[\]{}]+$', '', 'g') AS s FROM w)
SELECT w AS token, CASE WHEN s <> '' AND length(s) <= 64 AND (length(regexp_replace(s, '[^\p{L}]', '', 'g'))::DOUBLE / length(s) >= 0.35 OR regexp_matches(s, '[0-9]')) THEN s END AS clean FROM s""")
def fn_token_clean(spark, d):
    w = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return w.select("token", T.token_clean(F.col("token")).alias("clean"))


@query("fn_list_prefix", r"SELECT query_id, raw AS line FROM query_specs WHERE raw IS NOT NULL AND NOT regexp_matches(raw, '^\s|\s$|^[).\s-]')")
def fn_list_prefix(spark, d):
    q = _specs(spark, d).where("raw is not null").where(~F.col("raw").rlike(r"^\s|\s$|^[).\s-]"))
    numbered = F.concat(F.col("query_id").cast("string"), F.when(F.col("query_id") % 2 == 0, ") ").otherwise(". "), "raw")
    return q.select("query_id", T.list_prefix_stripped(numbered).alias("line"))


_SMALL = "['" + "','".join(T.KEYWORD_STOP_WORDS) + "']"


@query("fn_single_words", f"SELECT query_id, [w FOR w IN regexp_extract_all(array_to_string(list_filter([raw] || coalesce(keyword_boosted, []), lambda x: x IS NOT NULL), ' '), '[A-Za-z0-9]+') IF NOT list_contains({_SMALL}, lower(w))] AS words FROM query_specs")
def fn_single_words(spark, d):
    k = F.concat(F.array("raw"), F.coalesce("keyword_boosted", F.array().cast("array<string>")))
    return _specs(spark, d).select("query_id", T.single_words(k).alias("words"))


@query("fn_min_max", "SELECT query_id, chunk_id, logged_at, least(semantic_score, fused_score) AS low, greatest(semantic_score, fused_score) AS high FROM candidates")
def fn_min_max(spark, d):
    return table(spark, d, "candidates").select("query_id", "chunk_id", "logged_at", F.least("semantic_score", "fused_score").alias("low"), F.greatest("semantic_score", "fused_score").alias("high"))


@query("fn_vector_md5", "SELECT vec_id, md5(array_to_string([printf('%.6f', x::DOUBLE) FOR x IN embedding], '')) AS h FROM embeddings")
def fn_vector_md5(spark, d):
    return table(spark, d, "embeddings").select("vec_id", R.vector_md5(F.col("embedding")).alias("h"))


@query("fn_l2_normalised", "SELECT vec_id, [round(x::DOUBLE / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12), 5) FOR x IN embedding] AS unit FROM embeddings")
def fn_l2_normalised(spark, d):
    unit = l2_normalised(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.transform(unit, lambda x: F.round(x, 5)).alias("unit"))


# ---- projections and filters ----
@query("src_category_lists", rf"SELECT id, ingested_at FROM papers WHERE list_has_any(flatten([regexp_split_to_array({_S.format('x')}, '\s+') FOR x IN string_split(categories, ';')]), ['cs.CL', 'cs.IR'])")
def src_category_lists(spark, d):
    return table(spark, d, "papers").where(R.in_category_lists(F.split("categories", ";"), ["cs.CL", "cs.IR"])).select("id", "ingested_at")


@query("prj_author_list", rf"SELECT id, ingested_at, nullif(array_to_string([y FOR y IN [array_to_string(list_filter([{_S.format('p[2]')}, {_S.format('p[1]')}, {_S.format('p[3]')}], lambda x: x <> ''), ' ') FOR p IN authors_parsed] IF y <> ''], ', '), '') AS authors FROM papers")
def prj_author_list(spark, d):
    none = F.lit(None).cast("string")
    people = F.transform("authors_parsed", lambda p: F.struct(none.alias("name"), none.alias("full_name"), F.get(p, F.lit(1)).alias("first"), none.alias("middle"), F.get(p, F.lit(0)).alias("last"), F.get(p, F.lit(2)).alias("suffix")))
    return table(spark, d, "papers").select("id", "ingested_at", R.format_authors(people).alias("authors"))


@query("prj_date_list", rf"SELECT id, ingested_at, coalesce(nullif(regexp_extract({_S.format('update_date')}, '^[^T]*'), ''), strftime(ingested_at, '%Y-%m-%d')) AS day FROM papers")
def prj_date_list(spark, d):
    dates = F.array("update_date", F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm"))
    return table(spark, d, "papers").select("id", "ingested_at", R.first_date(dates).alias("day"))


@query("prj_venue_filter", "SELECT doc_id FROM documents WHERE contains(lower(source), 'review') OR contains(lower(lang), 'review') OR contains(lower(paper_id), 'review')")
def prj_venue_filter(spark, d):
    none = F.lit(None).cast("string")
    return table(spark, d, "documents").where(R.any_contains("Review", none, F.col("lang"), F.col("source"), F.col("paper_id"), none)).select("doc_id")


@query("prj_author_filter", "SELECT id, ingested_at FROM papers WHERE contains(lower(coalesce(nullif(authors, ''), array_to_string(list_filter(flatten(authors_parsed), lambda x: x IS NOT NULL), ' '), '')), 'patricia')")
def prj_author_filter(spark, d):
    return table(spark, d, "papers").where(R.author_contains("Patricia", F.col("authors"), F.flatten("authors_parsed"))).select("id", "ingested_at")


@query("prj_known_hits", "SELECT query_id, chunk_id, doc_id, logged_at FROM candidates WHERE chunk_id <> '' AND doc_id <> ''")
def prj_known_hits(spark, d):
    return R.known(table(spark, d, "candidates").select("query_id", "chunk_id", "doc_id", "logged_at"), "chunk_id", "doc_id")


@query("prj_kept_sections", rf"""SELECT q.query_id, a.doc_id, [h FOR h IN a.titles IF h <> '' AND (regexp_matches(lower(q.raw), '\breferenc|\bcitation') OR NOT (contains(lower(h), 'reference') OR contains(lower(h), 'bibliography')))] AS kept
FROM (SELECT DISTINCT query_id, doc_id FROM candidates) k JOIN query_specs q USING (query_id) JOIN (SELECT doc_id, list_sort(list(DISTINCT section_title) FILTER (section_title IS NOT NULL)) AS titles FROM chunks GROUP BY doc_id) a ON a.doc_id = k.doc_id WHERE a.titles IS NOT NULL AND q.raw IS NOT NULL""")
def prj_kept_sections(spark, d):
    titles = table(spark, d, "chunks").groupBy("doc_id").agg(F.array_sort(F.collect_set("section_title")).alias("titles")).where("size(titles) > 0")
    pairs = table(spark, d, "candidates").select("query_id", "doc_id").distinct()
    j = pairs.join(small_side(_specs(spark, d).where("raw is not null").select("query_id", "raw")), "query_id").join(titles, "doc_id")
    return j.select("query_id", "doc_id", T.kept_sections(F.col("titles"), F.col("raw")).alias("kept"))


@query("prj_default_sections", f"SELECT id, ingested_at, CASE WHEN len(list_filter(coalesce(headings, []), lambda h: {_S.format('h')} <> '')) > 0 THEN list_filter(headings, lambda h: {_S.format('h')} <> '') ELSE {T.DEFAULT_SECTIONS!r} END AS titles FROM chunks")
def prj_default_sections(spark, d):
    return table(spark, d, "chunks").select("id", "ingested_at", T.section_defaults(F.col("headings")).alias("titles"))


@query("prj_link", rf"SELECT doc_id, coalesce(nullif(paper_id, ''), 'file://' || nullif(source, ''), '') AS link, CASE WHEN length(x) > 120 THEN left(x, 120) || '…' ELSE x END AS short FROM (SELECT *, {_S.format('replace(coalesce(text, chr(32)), chr(10), chr(32))')} AS x FROM documents)")
def prj_link(spark, d):
    return table(spark, d, "documents").select("doc_id", R.link(F.col("paper_id"), F.col("source")).alias("link"), R.one_line(F.col("text"), 120).alias("short"))


@query("topk_bounds", "SELECT query_id, coalesce(least(greatest(CASE WHEN query_id % 7 = 0 THEN NULL ELSE query_id * 3 - 20 END, 1), 50), 15) AS k FROM query_specs")
def topk_bounds(spark, d):
    asked = F.when(F.col("query_id") % 7 != 0, F.col("query_id") * 3 - 20)
    return _specs(spark, d).select("query_id", R.top_k_bound(asked).alias("k"))


@query("join_page_interval", """
WITH c AS (SELECT * FROM (SELECT DISTINCT ON (id) id, doc_id, char_start, page_num FROM chunks ORDER BY id, ingested_at DESC)),
p AS (SELECT doc_id, page_num, min(char_start) AS lo FROM c WHERE page_num IS NOT NULL AND char_start IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, page_num, lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo, page_num) AS hi FROM p),
j AS (SELECT c.id, s.page_num, row_number() OVER (PARTITION BY c.id ORDER BY s.lo, s.page_num) AS n FROM c JOIN s ON s.doc_id = c.doc_id AND s.lo <= c.char_start AND (s.hi IS NULL OR s.hi = 0 OR s.hi > c.char_start))
SELECT id, page_num AS page FROM j WHERE n = 1""")
def join_page_interval(spark, d):
    """The page span that holds each chunk's start; the last span is open."""
    c = _chunks(spark, d, "doc_id", "char_start", "page_num")
    p = c.where("page_num is not null and char_start is not null").groupBy("doc_id", "page_num").agg(F.min("char_start").alias("lo"))
    # one row per page: a document has few of them
    s = p.withColumn("hi", F.lead("lo").over(Window.partitionBy("doc_id").orderBy("lo", "page_num"))).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("lo").alias("start"), F.col("page_num").alias("page"), F.col("hi").alias("end")))).alias("pages"))
    return c.join(small_side(s), "doc_id").select("id", C.page_at(F.col("char_start"), F.col("pages"))["page"].alias("page")).where("page is not null")


@query("join_zip_checked", "SELECT id, ingested_at, unnest(keyword_key) AS term, unnest([length(x) FOR x IN keyword_key]) AS n FROM chunks")
def join_zip_checked(spark, d):
    pairs = R.zip_checked(F.col("keyword_key"), F.transform("keyword_key", F.length), ("term", "n"))
    return table(spark, d, "chunks").select("id", "ingested_at", F.explode(pairs).alias("x")).select("id", "ingested_at", "x.term", F.col("x.n").cast("long").alias("n"))


@query("agg_anchors_of", f"""
WITH c AS ({_LATEST_CHUNKS}), w AS (SELECT DISTINCT paper_id AS doc_id FROM documents WHERE paper_id IS NOT NULL)
SELECT doc_id, section_title AS term, count(*) AS n FROM c SEMI JOIN w USING (doc_id) WHERE section_title IS NOT NULL GROUP BY ALL""")
def agg_anchors_of(spark, d):
    """Section titles of the wanted documents alone, each named once however often it is asked for."""
    wanted = table(spark, d, "documents").select(F.col("paper_id").alias("doc_id")).where("doc_id is not null").distinct()
    return _chunks(spark, d, "doc_id", "section_title").where("section_title is not null").join(wanted, "doc_id", "left_semi").groupBy("doc_id", F.col("section_title").alias("term")).agg(F.count("*").alias("n"))


@query("agg_ordered_dedupe", """
WITH k AS (SELECT query_id, coalesce(keyword_boosted, []) || coalesce(keyword_regular, []) || coalesce(keyword_boosted, []) AS k FROM query_specs)
SELECT query_id, [k[i] FOR i IN range(1, len(k) + 1) IF list_position(k, k[i]) = i] AS kept FROM k""")
def agg_ordered_dedupe(spark, d):
    b, r = (F.coalesce(c, F.array().cast("array<string>")) for c in ("keyword_boosted", "keyword_regular"))
    return _specs(spark, d).select("query_id", F.array_distinct(F.concat(b, r, b)).alias("kept"))


@query("agg_first_copies", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY trim(text)")
def agg_first_copies(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2(F.trim("text"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


# ---- query understanding ----
_KW = "coalesce(keyword_boosted, []) || coalesce(keyword_regular, [])"


@query("query_analysis", f"""SELECT query_id, CASE WHEN query_id % 5 = 0 THEN 'find_specific_paper' WHEN intent IN ('find_papers', 'find_specific_paper', 'find_author') THEN intent ELSE 'find_papers' END AS intent,
 CASE WHEN query_id % 3 = 0 THEN {_S.format('raw')} ELSE coalesce(nullif(array_to_string({_KW}, ' '), ''), {_S.format('raw')}) END AS keyword_query, CASE WHEN query_id % 2 = 0 THEN 2019 END AS year_min, ['recent'] AS qualifiers FROM query_specs WHERE raw IS NOT NULL""")
def query_analysis(spark, d):
    """An analyzer's JSON answers, read and completed."""
    kw = F.array_join(F.concat(F.coalesce("keyword_boosted", F.array().cast("array<string>")), F.coalesce("keyword_regular", F.array().cast("array<string>"))), " ")
    raw = F.to_json(F.struct(
        "intent", F.when(F.col("query_id") % 3 != 0, kw).alias("keyword_query"), F.when(F.col("query_id") % 5 == 0, "specific").alias("broad_or_specific"),
        F.array(F.lit("recent"), F.lit("unheard of")).alias("qualifiers"), F.struct(F.when(F.col("query_id") % 2 == 0, 2019).alias("year_min")).alias("metadata_filters"),
    ))
    q = _specs(spark, d).where("raw is not null").select("query_id", Q.parse_analysis(raw, F.col("raw")).alias("a"))
    return q.select("query_id", "a.intent", "a.keyword_query", "a.year_min", "a.qualifiers")


@query("query_string_clauses", """
WITH p AS (SELECT query_id, keyword_boosted[1] AS b, keyword_regular[1] AS r, raw FROM query_specs WHERE len(keyword_boosted) > 0 AND len(keyword_regular) > 0 AND raw IS NOT NULL)
SELECT query_id, b AS text, false AS is_phrase, true AS must FROM p WHERE b NOT LIKE '% %' UNION ALL SELECT query_id, r, false, false FROM p WHERE b NOT LIKE '% %' UNION ALL SELECT query_id, replace(raw, '"', ''), true, false FROM p WHERE b NOT LIKE '% %'""")
def query_string_clauses(spark, d):
    q = _specs(spark, d).where("size(keyword_boosted) > 0 and size(keyword_regular) > 0 and raw is not null and keyword_boosted[0] not like '% %'")
    line = F.concat(F.lit("  +"), F.get("keyword_boosted", F.lit(0)), F.lit(" - "), F.get("keyword_regular", F.lit(0)), F.lit(' "'), F.replace("raw", F.lit('"'), F.lit("")), F.lit('" "" '))
    return q.select("query_id", F.explode(Q.parsed_query_string(line)).alias("c")).select("query_id", "c.*")


@query("query_clauses", f"""
WITH k AS (SELECT query_id, [{_S.format('x')} FOR x IN coalesce(keyword_boosted, []) IF trim(x) <> ''] AS b, [{_S.format('x')} FOR x IN coalesce(keyword_regular, []) || coalesce(keyword_regular, []) IF trim(x) <> ''] AS r FROM query_specs)
SELECT query_id, unnest([{{'text': b[i], 'must': true}} FOR i IN range(1, len(b) + 1) IF list_position(b, b[i]) = i] || [{{'text': r[i], 'must': false}} FOR i IN range(1, len(r) + 1) IF list_position(r, r[i]) = i], recursive := true),
 CASE WHEN len(r) > 0 THEN array_to_string(r, ' ') WHEN len(b) > 0 THEN array_to_string(b, ' ') ELSE 'keyword' END AS combined FROM k""")
def query_clauses(spark, d):
    twice = F.concat(F.coalesce("keyword_regular", F.array().cast("array<string>")), F.coalesce("keyword_regular", F.array().cast("array<string>")))
    q = _specs(spark, d).select("query_id", Q.query_text(F.col("keyword_boosted"), twice).alias("combined"), F.explode(Q.query_clauses(F.col("keyword_boosted"), twice)).alias("c"))
    return q.select("query_id", "combined", "c.text", "c.must")


@query("query_search_text", f"SELECT query_id, coalesce(nullif({_S.format('CASE WHEN query_id % 3 = 0 THEN intent WHEN query_id % 3 = 1 THEN chr(32) END')}, ''), {_S.format('raw')}) AS text FROM query_specs")
def query_search_text(spark, d):
    """A generated text takes the question's place unless it is missing or blank."""
    generated = F.when(F.col("query_id") % 3 == 0, F.col("intent")).when(F.col("query_id") % 3 == 1, F.lit(" "))
    return _specs(spark, d).select("query_id", Q.search_text(generated, F.col("raw")).alias("text"))


@query("query_spans", r"SELECT query_id, regexp_extract_all(raw, '\b[A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+)+') AS spans FROM query_specs WHERE raw IS NOT NULL")
def query_spans(spark, d):
    return _specs(spark, d).where("raw is not null").select("query_id", Q.entity_spans(F.col("raw")).alias("spans"))


@query("query_raw_terms", rf"""
WITH p AS (SELECT query_id, regexp_extract_all(raw, '(\b[A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+)+|[A-Za-z0-9][A-Za-z0-9\-]+)', 1) AS p FROM query_specs WHERE raw IS NOT NULL),
t AS (SELECT query_id, list_filter(list_transform(p, lambda x: CASE WHEN regexp_matches(x, '\s') THEN x ELSE lower(x) END), lambda x: NOT list_contains({_STOPS}, x)) AS t FROM p)
SELECT query_id, [t[i] FOR i IN range(1, len(t) + 1) IF list_position(t, t[i]) = i] AS terms FROM t""")
def query_raw_terms(spark, d):
    return _specs(spark, d).where("raw is not null").select("query_id", Q.raw_terms(F.col("raw")).alias("terms"))


@query("query_analyzer_terms", rf"""
WITH k AS (SELECT query_id, raw, list_filter(coalesce(keyword_boosted, []) || coalesce(keyword_regular, []), lambda x: x <> '') AS k, regexp_extract_all(lower(raw), '[a-z0-9][a-z0-9\-]+') AS t FROM query_specs)
SELECT query_id, CASE WHEN len(k) > 0 THEN [k[i] FOR i IN range(1, len(k) + 1) IF list_position(k, k[i]) = i] ELSE [t[i] FOR i IN range(1, len(t) + 1) IF list_position(t, t[i]) = i] END AS terms FROM k""")
def query_analyzer_terms(spark, d):
    none = F.lit(None).cast("array<string>")
    return _specs(spark, d).select("query_id", Q.analyzer_terms(none, F.col("keyword_boosted"), F.col("keyword_regular"), F.col("raw")).alias("terms"))


@query("query_model_pick", f"""
WITH a AS (SELECT doc_id, list_sort(list(DISTINCT m)) AS names FROM (SELECT doc_id, unnest(model_names) AS m FROM ({_LATEST_CHUNKS})) GROUP BY doc_id)
SELECT DISTINCT k.query_id, k.doc_id, CASE WHEN contains(lower(raw), 'model') OR k.query_id % 2 = 0 THEN [n FOR n IN names IF trim(n) <> ''][1] END AS model FROM candidates k JOIN query_specs USING (query_id) JOIN a ON a.doc_id = k.doc_id WHERE raw IS NOT NULL""")
def query_model_pick(spark, d):
    """The first model name of a candidate's document, if the question (or every second one, as marked) speaks of a model."""
    a = _chunks(spark, d, "doc_id", "model_names").select("doc_id", F.explode("model_names").alias("m")).groupBy("doc_id").agg(F.array_sort(F.collect_set("m")).alias("names"))
    asked = F.when(F.col("query_id") % 2 == 0, F.concat("raw", F.lit(" model"))).otherwise(F.col("raw"))
    q = _specs(spark, d).where("raw is not null").select("query_id", asked.alias("raw"))
    pairs = table(spark, d, "candidates").select("query_id", "doc_id").distinct()
    return pairs.join(small_side(q), "query_id").join(a, "doc_id").select("query_id", "doc_id", Q.model_pick(F.col("raw"), F.col("names")).alias("model"))


@query("query_section_score", rf"""
WITH t AS (SELECT DISTINCT k.query_id, c.section_title, raw FROM candidates k JOIN ({_LATEST_CHUNKS}) c ON c.id = k.chunk_id JOIN query_specs USING (query_id) WHERE c.section_title IS NOT NULL AND raw IS NOT NULL),
s AS (SELECT *, list_distinct(regexp_extract_all(lower(raw), '[a-z0-9][a-z0-9\-]+')) AS a, list_distinct(regexp_extract_all(lower(section_title), '[a-z0-9][a-z0-9\-]+')) AS b FROM t), n AS (SELECT *, len(list_intersect(a, b)) AS n FROM s)
SELECT query_id, section_title, round(n + CASE WHEN len(b) > 0 THEN n::DOUBLE / len(b) ELSE 0 END + CASE WHEN regexp_matches(section_title, '^[A-Z]') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(b) <= 4 THEN 0.05::DOUBLE ELSE 0 END, 6) AS score FROM n""")
def query_section_score(spark, d):
    k = table(spark, d, "candidates").select("query_id", "chunk_id").distinct().join(_chunks(spark, d, "section_title"), F.col("chunk_id") == F.col("id"))
    t = k.where("section_title is not null").select("query_id", "section_title").distinct().join(small_side(_specs(spark, d).where("raw is not null").select("query_id", "raw")), "query_id")
    return t.select("query_id", "section_title", F.round(Q.section_score(F.col("raw"), F.col("section_title")), 6).alias("score"))


_CANDIDATES = r"""
WITH p AS (SELECT query_id, regexp_extract_all(raw, '[A-Za-z0-9][A-Za-z0-9\-]+') AS t, regexp_split_to_array(raw, '[A-Za-z0-9][A-Za-z0-9\-]+') AS g FROM query_specs WHERE raw IS NOT NULL),
u AS (SELECT query_id, unnest(range(len(t))) AS pos, unnest(t) AS surface, unnest(g[1:len(t)]) AS gap FROM p),
o AS (SELECT query_id, pos, surface, lower(surface) AS lemma, sum(length(gap) + length(surface)) OVER (PARTITION BY query_id ORDER BY pos) - length(surface) AS start FROM u),
s AS (SELECT *, list_contains({stops}, lemma) AS stop FROM o), g AS (SELECT *, sum(stop::INT) OVER (PARTITION BY query_id ORDER BY pos) AS grp FROM s),
l AS (SELECT *, count(*) OVER (PARTITION BY query_id, grp) AS len FROM g WHERE NOT stop), w AS (SELECT *, (sum(len - 1) OVER x + count(*) OVER x)::DOUBLE / count(*) OVER x AS ws FROM l WINDOW x AS (PARTITION BY query_id, lemma)),
ph AS (SELECT query_id, grp, any_value(len) AS len, string_agg(surface, ' ' ORDER BY pos) AS term, min(start) AS start, sum(ws) AS base, bool_and(regexp_matches(surface, '^[A-Z]')) AS caps, bool_or(regexp_matches(surface, '[0-9]')) AS digit, bool_or(length(lemma) >= 3) AS long, bool_or(regexp_matches(surface, '^[A-Z0-9\-]*[A-Z][A-Z0-9\-]*$')) AS acronym FROM w GROUP BY query_id, grp),
r AS (SELECT query_id, term, base + CASE WHEN len > 1 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN caps THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN digit THEN 0.2::DOUBLE ELSE 0 END + greatest(0, 0.4::DOUBLE - start * 0.01::DOUBLE) AS score, 'rake' AS source FROM ph
 WHERE len <= 5 AND length(term) <= 96 AND length(regexp_replace(term, '[^\p{L}]', '', 'g'))::DOUBLE / length(term) >= 0.35 AND (len = 1 OR caps OR digit) AND (long OR (len > 1 AND caps) OR acronym OR digit)),
a AS (SELECT query_id, unnest(keyword_regular) AS term, 2.4::DOUBLE AS score, 'section' AS source FROM query_specs UNION ALL SELECT query_id, unnest(keyword_boosted), 2.2::DOUBLE, 'model' FROM query_specs),
c AS (SELECT unnest([{cues}]) AS cue, unnest([{terms}]) AS terms), i AS (SELECT query_id, unnest(terms) AS term, 2.0::DOUBLE AS score, 'intent' AS source FROM query_specs JOIN c ON contains(lower(raw), cue))
""".replace("{stops}", _STOPS).replace("{cues}", ", ".join(repr(k) for k in T.INTENT_CUES)).replace("{terms}", ", ".join(str(v) for v in T.INTENT_CUES.values()))


@query("query_candidates", _CANDIDATES + "SELECT query_id AS qid, lower(term) AS term, round(max(score), 6) AS score, list_sort(list(DISTINCT source)) AS sources FROM (SELECT * FROM r UNION ALL SELECT * FROM a UNION ALL SELECT * FROM i) GROUP BY query_id, lower(term)")
def query_candidates(spark, d):
    """Candidate terms: phrases of the question, its regular keywords as section titles, its boosted ones as model names, intents."""
    q = _specs(spark, d)
    anchors = q.select(F.col("query_id").alias("qid"), F.col("keyword_regular").alias("section_titles"), F.col("keyword_boosted").alias("model_names"))
    return Q.scored_candidates(q.select(F.col("query_id").alias("qid"), F.col("raw").alias("text")), anchors)


@query("query_set", "SELECT query_id AS qid, 5 AS queries, true AS raw_first, true AS boosts_as_told FROM query_specs WHERE raw IS NOT NULL AND len(keyword_boosted || keyword_regular) > 0")
def query_set(spark, d):
    """Five queries a question: the raw terms, two with two boosted terms, two with one; whether they are made as told."""
    q = _specs(spark, d).where("raw is not null and size(concat(keyword_boosted, keyword_regular)) > 0")
    asked = q.select(F.col("query_id").alias("qid"), F.col("raw").alias("text"), F.concat("keyword_boosted", "keyword_regular").alias("ranked"), F.array(F.lit("Method"), F.lit("Results")).alias("sections"))
    g = Q.keyword_queries(asked).groupBy("qid").agg(F.count("*").cast("int").alias("queries"), F.bool_and((F.col("number") > 0) | (F.size("boosted") == 0)).alias("raw_first"), F.bool_and(F.size("boosted") <= F.when(F.col("number") <= 2, 2).otherwise(1)).alias("boosts_as_told"))
    return g


# ---- fusion and reranking ----
@query("sort_hybrid", f"SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC NULLS LAST, list_max(map_values(lexical_scores)) DESC NULLS LAST, semantic_score DESC NULLS LAST, chunk_id) AS rank FROM ({_LOGGED}) QUALIFY rank <= 10")
def sort_hybrid(spark, d):
    k = _logged(spark, d, "fused_score", "semantic_score", "lexical_scores").withColumn("lexical", F.array_max(F.map_values("lexical_scores")))
    w = Window.partitionBy("query_id").orderBy(F.col("fused_score").desc_nulls_last(), F.col("lexical").desc_nulls_last(), F.col("semantic_score").desc_nulls_last(), "chunk_id")
    return k.select("query_id", "chunk_id", F.row_number().over(w).alias("rank")).where("rank <= 10")


_INFORMATIVE = r"(length(s) >= 12 AND NOT (upper(s) = s AND lower(s) <> s AND length(s) > 15) AND length(regexp_replace(s, '[^\p{L}]', '', 'g'))::DOUBLE / length(s) >= 0.4 AND len(list_distinct(regexp_extract_all(lower(s), '\w+'))) >= 4)"
_BEST = rf"""
WITH k AS ({_LOGGED}), c AS ({_LATEST_CHUNKS}), q AS (SELECT query_id, list_distinct([lower(x) FOR x IN coalesce(keyword_boosted, []) || coalesce(keyword_regular, [])]) AS wanted FROM query_specs),
j AS (SELECT query_id, k.chunk_id, wanted, CASE WHEN text IS NULL THEN [] ELSE {_SENTENCES} END AS ss FROM k JOIN c ON c.id = k.chunk_id JOIN q USING (query_id)),
e AS (SELECT query_id, chunk_id, wanted, unnest(range(len(ss))) AS pos, unnest(ss) AS s FROM j),
x AS (SELECT query_id, chunk_id, pos, s, round(CASE WHEN len(wanted) > 0 THEN len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[a-z0-9][a-z0-9\-]+')), wanted))::DOUBLE / len(wanted) ELSE 0 END + 0.1::DOUBLE * (length(regexp_replace(s, '[^\p{{L}}]', '', 'g'))::DOUBLE / length(s)), 6) AS score FROM e WHERE {_INFORMATIVE}),
b AS (SELECT query_id, chunk_id, score, s FROM x QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, pos) = 1),
f AS (SELECT j.query_id, j.chunk_id, coalesce(b.score, -1) AS score, coalesce(b.s, j.ss[1], '') AS sentence, wanted FROM j LEFT JOIN b USING (query_id, chunk_id))
"""


def _best_sentences(spark, d):
    k, c = _logged(spark, d), _chunks(spark, d, "text")
    q = _specs(spark, d).select("query_id", F.array_distinct(F.transform(F.concat(F.coalesce("keyword_boosted", F.array().cast("array<string>")), F.coalesce("keyword_regular", F.array().cast("array<string>"))), F.lower)).alias("wanted"))
    j = k.join(c, F.col("chunk_id") == F.col("id")).join(small_side(q), "query_id")
    return j.select("query_id", "chunk_id", "wanted", U.best_sentence(F.col("text"), F.col("wanted")).alias("b")).select("query_id", "chunk_id", "wanted", "b.score", "b.sentence")


@query("fuse_best_sentence", _BEST + "SELECT query_id, chunk_id, score, sentence FROM f")
def fuse_best_sentence(spark, d):
    return _best_sentences(spark, d).drop("wanted")


@query("fuse_keyword_overlap", _BEST + f""", o AS (SELECT query_id, chunk_id, sentence, CASE WHEN len(list_filter(wanted, lambda x: x <> '')) > 0 THEN len(list_intersect(list_distinct({_lemmas('sentence')}), wanted))::DOUBLE / len(list_filter(wanted, lambda x: x <> '')) ELSE 0 END AS overlap FROM f),
h AS (SELECT query_id, chunk_id, list_max(map_values(lexical_scores)) AS lex, semantic_score AS sem FROM k)
SELECT query_id, chunk_id, round(coalesce(lex / nullif(max(lex) OVER w, 0), 0) + coalesce(sem / nullif(max(sem) OVER w, 0), 0) + 0.5::DOUBLE * overlap, 6) AS score FROM o JOIN h USING (query_id, chunk_id) WINDOW w AS (PARTITION BY query_id)""")
def fuse_keyword_overlap(spark, d):
    """Both scores by their maxima, plus half of the share of keywords that the best sentence holds."""
    s = _best_sentences(spark, d).select("query_id", "chunk_id", T.term_overlap(F.col("sentence"), F.col("wanted")).alias("overlap"))
    h = _logged(spark, d, "lexical_scores", "semantic_score").select("query_id", "chunk_id", F.array_max(F.map_values("lexical_scores")).alias("lexical_score"), "semantic_score")
    m = U.max_normalised(s.join(h, ["query_id", "chunk_id"]).withColumnRenamed("query_id", "qid"), digits=12)
    return m.select(F.col("qid").alias("query_id"), "chunk_id", F.round(F.col("fused") + 0.5 * F.col("overlap"), 6).alias("score"))


def _state(s: str) -> str:
    """The SQL of ``functions.text.completeness`` of a stripped text."""
    n = rf"(regexp_matches({s}, '(^|\n)\s*([\-•\*]|[0-9]+[.)])')::INT + regexp_matches({s}, '^\p{{Ll}}')::INT + (NOT regexp_matches({s}, '[.?!]$'))::INT + (contains(lower({s}), 'as above') OR regexp_extract(lower({s}), '([^\s]+)$', 1) IN ('these', 'those', 'following'))::INT)"
    return f"CASE WHEN {s} = '' OR {n} >= 2 THEN 'INCOMPLETE' WHEN {n} = 1 THEN 'PARTIAL' ELSE 'COMPLETE' END"


@query("fuse_expand_adjacent", f"""
WITH c AS (SELECT id, doc_id, chunk_id, text FROM (SELECT DISTINCT ON (id) * FROM chunks WHERE text IS NOT NULL ORDER BY id, ingested_at DESC)),
n AS (SELECT *, lag(text) OVER w AS before, lead(text) OVER w AS n1, lead(text, 2) OVER w AS n2 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id, id)),
a AS (SELECT *, {_state(_S.format('text'))} AS s0 FROM n), b AS (SELECT *, CASE WHEN s0 = 'INCOMPLETE' AND before IS NOT NULL THEN before || ' ' || text ELSE text END AS c0 FROM a),
x AS (SELECT *, CASE WHEN s0 <> 'COMPLETE' AND n1 IS NOT NULL THEN c0 || ' ' || n1 ELSE c0 END AS c1 FROM b), y AS (SELECT *, CASE WHEN s0 <> 'COMPLETE' AND n1 IS NOT NULL THEN {_state(_S.format('c1'))} ELSE s0 END AS s1 FROM x),
z AS (SELECT *, CASE WHEN s1 <> 'COMPLETE' AND n2 IS NOT NULL THEN c1 || ' ' || n2 ELSE c1 END AS c2 FROM y)
SELECT id, c2 AS context, CASE WHEN s1 <> 'COMPLETE' AND n2 IS NOT NULL THEN {_state(_S.format('c2'))} ELSE s1 END AS state FROM z""")
def fuse_expand_adjacent(spark, d):
    c = latest_rows(table(spark, d, "chunks").where("text is not null").select("id", "doc_id", "chunk_id", "text", "ingested_at"), ["id"], "ingested_at")
    return U.expanded(c.select("id", "doc_id", "chunk_id", "text")).select("id", "context", "state")


@query("rerank_cross", rf"""
WITH j AS (SELECT k.query_id, k.chunk_id, list_distinct(regexp_extract_all(lower(coalesce(raw, '')), '\w+')) AS a, list_distinct(regexp_extract_all(lower(concat_ws(' [SEP] ', nullif({_S.format('section_title')}, ''), nullif({_S.format('text')}, ''))), '\w+')) AS b FROM ({_LOGGED}) k JOIN ({_LATEST_CHUNKS}) c ON c.id = k.chunk_id JOIN query_specs USING (query_id)),
s AS (SELECT query_id, chunk_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b))::DOUBLE / len(a), 6) END AS score FROM j)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank FROM s QUALIFY rank <= 10""")
def rerank_cross(spark, d):
    """Candidates by a cross-encoder's place-holder, which reads section title and text; no score sorts last."""
    j = _logged(spark, d).join(_chunks(spark, d, "section_title", "text"), F.col("chunk_id") == F.col("id")).join(small_side(_specs(spark, d).select("query_id", "raw")), "query_id")
    j = j.select("query_id", "chunk_id", "raw", R.rerank_text(F.col("section_title"), F.col("text")).alias("passage"))
    s = cross_scored(j, "raw", "passage", OverlapScorer).select("query_id", "chunk_id", F.round("cross_score", 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "chunk_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query("rerank_listed", f"""
WITH k AS ({_LOGGED}), c AS ({_LATEST_CHUNKS}), t AS (SELECT query_id, k.chunk_id, {_S.format('text')} AS t FROM k JOIN c ON c.id = k.chunk_id WHERE text IS NOT NULL),
o AS (SELECT query_id, t, min(chunk_id) AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(chunk_id) DESC) AS pos FROM t GROUP BY query_id, t),
h AS (SELECT t.query_id, t.chunk_id, o.pos FROM t JOIN o USING (query_id, t)) SELECT query_id AS qid, chunk_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY pos, chunk_id) AS rank FROM h""")
def rerank_listed(spark, d):
    """A model's numbered list of texts, here in falling order of their ids, put back on the candidates."""
    t = _logged(spark, d).join(_chunks(spark, d, "text"), F.col("chunk_id") == F.col("id")).where("text is not null").select(F.col("query_id").alias("qid"), F.col("chunk_id").alias("id"), "text")
    first = t.groupBy("qid", T.strip(F.col("text")).alias("t")).agg(F.min("id").alias("id"))
    lines = first.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("id"))))
    answers = lines.select("qid", "pos", F.concat(F.col("pos").cast("string"), F.lit(") "), "t").alias("line"))
    return P.rank_by_lists(answers, t)


@query("prj_provenance", f"SELECT k.query_id, k.chunk_id, c.doc_id, c.section_title, c.page_num, c.char_start AS lo, c.char_end AS hi FROM ({_LOGGED}) k JOIN ({_LATEST_CHUNKS}) c ON c.id = k.chunk_id")
def prj_provenance(spark, d):
    k = _logged(spark, d).withColumn("id", F.col("chunk_id"))
    c = _chunks(spark, d, "doc_id", "chunk_id", "section_title", "page_num", "char_start", "char_end")
    p = P.with_provenance(k, c)
    return p.select("query_id", F.col("id").alias("chunk_id"), "provenance.doc_id", "provenance.section_title", "provenance.page_num", F.col("provenance.char_span.start").alias("lo"), F.col("provenance.char_span.end").alias("hi"))


@query("filter_and_sort", rf"""
WITH p AS ({_LATEST_PAPERS}), y AS (SELECT id, try_cast(nullif(regexp_extract(update_date, '((?:19|20)\d{{2}})', 1), '') AS INT) AS y, authors, regexp_split_to_array({_S.format('categories')}, '\s+') AS cats FROM p)
SELECT id, y, row_number() OVER (ORDER BY y DESC, id) AS rank FROM y WHERE y BETWEEN 2018 AND 2023 AND contains(lower(authors), 'a') AND list_bool_or([contains(lower(x), 'cs') FOR x IN cats]) QUALIFY rank <= 50""")
def filter_and_sort(spark, d):
    """Bounds of years, an author and a field of study, then the newest fifty."""
    p = _papers(spark, d, "update_date", "authors", "categories").withColumn("categories", F.split(T.strip(F.col("categories")), r"\s+"))
    kept = P.post_filter(p, 2018, 2023, author="A", field="cs").select("id", R.year(F.col("update_date")).alias("y"))
    return kept.orderBy(F.desc("y"), "id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("y"), "id")))  # 50 rows


_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_NORM = "(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query("topk_papers", f"""
WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, b.label, round({_DOT} / {_NORM}, 6) AS score FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 100 = 0),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 20)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f WHERE contains(label::VARCHAR, '1') QUALIFY rank <= 5""")
def topk_papers(spark, d):
    """Twenty nearest fetched, filtered by their field, cut to five."""
    v = _vectors(spark, d).select("id", F.col("v").alias("vector"), F.array(F.col("label").cast("string")).alias("categories"))
    q = _vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("qid"), "v")
    return P.paper_search(v, q, 5, fetch=20, field="1").select("qid", "id", "score", "rank")


@query("vec_knn", f"""
WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round({_DOT} / {_NORM}, 6) AS score FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 100 = 0 AND b.label <> 2) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def vec_knn(spark, d):
    """Ten neighbours out of max(2 k, 100) candidates, among the rows of a filter."""
    q = _vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("qid"), "v")
    return P.knn(_vectors(spark, d), q, 10, filters=F.col("label") != 2)


@query("vec_approximate", "SELECT vec_id AS qid, 10::BIGINT AS hits, true AS recall_over_nine_tenths, true AS scores_exact FROM embeddings WHERE vec_id % 100 = 0")
def vec_approximate(spark, d):
    """Ten neighbours by the inverted file, against the exact ones: recall of all queries together, and equal scores."""
    v = _vectors(spark, d).select("id", "v")
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "v")
    near = approximate_topk(v, q, 10)
    exact = vector_topk(v, q, 10, keep_self=True).select("qid", "id", F.col("score").alias("told"))
    j = near.join(exact, ["qid", "id"], "left")
    w = Window.partitionBy()  # one row a query
    g = j.groupBy("qid").agg(F.count("*").alias("hits"), F.count("told").alias("met"), F.bool_and(F.coalesce(F.abs(F.col("score") - F.col("told")) <= 2e-6, F.lit(True))).alias("scores_exact"))
    return g.select("qid", "hits", (F.sum("met").over(w) >= 0.9 * F.sum("hits").over(w)).alias("recall_over_nine_tenths"), "scores_exact")


@query("vec_rerank_second", f"""
WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round({_DOT} / {_NORM}, 6) AS score, list_inner_product([abs(x)::DOUBLE FOR x IN a.embedding], [abs(x)::DOUBLE FOR x IN b.embedding]) AS second FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 100 = 0),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 30) SELECT qid, id, round(second, 6) AS second, row_number() OVER (PARTITION BY qid ORDER BY round(second, 6) DESC, id) AS rank FROM f QUALIFY rank <= 10""")
def vec_rerank_second(spark, d):
    """Thirty nearest by one embedding, the best ten of them by a second one (here the absolute values of the first)."""
    v = _vectors(spark, d)
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "v")
    near = vector_topk(v, q, 30, keep_self=True).select("qid", "id")
    second = v.select("id", F.transform("v", lambda x: F.abs(x)).alias("w"))
    j = near.join(second, "id").join(second.select(F.col("id").alias("qid"), F.col("w").alias("u")), "qid")
    return L.top_per_query(j.select("qid", "id", F.round(dot(F.col("u"), F.col("w")), 6).alias("second")), 10, F.desc("second"), "id")


@query("vec_quotes", f"""
WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round({_DOT} / {_NORM}, 6) AS score FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 100 = 0),
r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5) SELECT qid, rank, text AS quote FROM r JOIN documents ON doc_id = id""")
def vec_quotes(spark, d):
    """The texts of the documents whose vectors are nearest."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    v = _vectors(spark, d)
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "v")
    return P.semantic_quotes(v.select("id", F.col("v").alias("vector")), q, 5, docs)


_L2 = f"round(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) + list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) - 2 * {_DOT}, 6)"


@query("vec_questions", f"""
WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, {_L2} AS distance FROM embeddings a JOIN embeddings b ON true JOIN documents d ON d.doc_id = b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM s QUALIFY rank <= 5) SELECT qid, id, rank, d.text, ({_SENTENCES})[1] AS question, distance FROM r JOIN documents d ON d.doc_id = id""")
def vec_questions(spark, d):
    """Documents whose question (here the first sentence) has the nearest vector, with the raw distance."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.get(T.sentences(F.col("text")), F.lit(0)).alias("question"))
    v = _vectors(spark, d)
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "v")
    return P.question_search(docs.join(v.select("id", F.col("v").alias("vector")), "id"), q, 5)


@query("join_metadata_left", f"SELECT d.doc_id, coalesce(nullif({_S.format('p.title')}, ''), '') AS title, coalesce(nullif({_S.format('p.categories')}, ''), '') AS categories FROM documents d LEFT JOIN ({_LATEST_PAPERS}) p ON p.id = d.paper_id")
def join_metadata_left(spark, d):
    from papyra.sources.papers import with_metadata

    docs = table(spark, d, "documents").select("doc_id", F.col("paper_id").alias("arxiv_id"))
    meta = _papers(spark, d, "title", "categories").select(F.col("id").alias("arxiv_id"), *[F.nullif(T.strip(F.col(c)), F.lit("")).alias(c) for c in ("title", "categories")])
    return with_metadata(docs, meta, ["title", "categories"]).select("doc_id", "title", "categories")


@query("fn_closed_sentences", rf"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\s)', '\1' || chr(31) || '\2', 'g'), chr(31)) AS p, {_S.format("regexp_extract(text, '([^.!?]*)$', 1)")} AS rest FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, list_filter(list_transform(p, lambda x: {_S.format("regexp_extract(x, '[^.!?]+[.!?]+$')")}) || [rest], lambda x: x <> '') AS s FROM s)
SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM l""")
def fn_closed_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.closed_sentences(F.col("text"))).alias("pos", "sentence"))


@query("chunk_headings", r"""
WITH l AS (SELECT doc_id AS id, unnest(range(len(x)))::INT AS line, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
s AS (SELECT id, line, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM l)
SELECT id, line, s AS title FROM s WHERE s <> '' AND length(s) <= 120 AND s NOT LIKE '%.' AND (regexp_matches(s, '^([0-9]+(\.[0-9]+)*)\s+[^\d]+') OR length(regexp_replace(s, '[^\p{Lu}]', '', 'g'))::DOUBLE / greatest(1, length(regexp_replace(s, '[^\p{L}]', '', 'g'))) > 0.6
 OR (regexp_matches(s, '\p{L}') AND NOT regexp_matches(s, '(^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}')))""")
def chunk_headings(spark, d):
    return C.heading_lines(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null"))
