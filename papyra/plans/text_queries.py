"""Queries of the text functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.plans.registry import query, table

#: DuckDB has no lookbehind: sentences are cut at a marker put after each end
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_STOPS = "['" + "','".join(T.STOP_WORDS) + "']"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("fn_tokens", r"SELECT doc_id, len(regexp_extract_all(text, '[^\s]+')) AS n_tokens, len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]+')) AS n_keywords, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_terms FROM documents")
def fn_tokens(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", F.size(T.tokens(t)).alias("n_tokens"), F.size(T.keyword_tokens(t)).alias("n_keywords"), F.size(F.array_distinct(T.plain_terms(t))).alias("n_terms"))


@query("fn_lemma_plural", r"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]+')) AS w FROM documents)
SELECT CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND w LIKE '%ses' THEN w[:-3]
            WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS lemma, count(*) AS n FROM w GROUP BY 1""")
def fn_lemma_plural(spark, d):
    w = docs(spark, d).select(F.explode(T.keyword_tokens(F.col("text"))).alias("w"))
    return w.groupBy(T.lemma_plural(F.col("w")).alias("lemma")).agg(F.count("*").alias("n"))


@query("fn_lemma", r"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]+')) AS w FROM documents)
SELECT CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND w LIKE '%ses' THEN w[:-3] WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-5]
            WHEN length(w) > 4 AND w LIKE '%ed' THEN w[:-4] WHEN length(w) > 4 AND w LIKE '%ly' THEN w[:-3] WHEN length(w) > 4 AND w LIKE '%er' THEN w[:-3]
            WHEN length(w) > 5 AND w LIKE '%est' THEN w[:-4] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS lemma, count(*) AS n FROM w GROUP BY 1""")
def fn_lemma(spark, d):
    w = docs(spark, d).select(F.explode(T.keyword_tokens(F.col("text"))).alias("w"))
    return w.groupBy(T.lemma(F.col("w")).alias("lemma")).agg(F.count("*").alias("n"))


@query("fn_stop_words", f"SELECT query_id, coalesce(nullif(array_to_string(list_filter(regexp_extract_all(lower(raw), '[a-z0-9'']+'), lambda x: NOT list_contains({_STOPS}, x)), ' '), ''), raw) AS stripped FROM query_specs")
def fn_stop_words(spark, d):
    return table(spark, d, "query_specs").select("query_id", T.strip_stop_words(F.col("raw")).alias("stripped"))


@query("fn_sentences", f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents) SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM s")
def fn_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query("fn_first_sentences", f"SELECT doc_id, array_to_string(({_SENTENCES})[1:2], ' ') AS lead FROM documents")
def fn_first_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(F.slice(T.sentences(F.col("text")), 1, 2), " ").alias("lead"))


@query("fn_alpha_ratio", r"SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE / length(text), 6) AS ratio FROM documents WHERE length(text) > 0")
def fn_alpha_ratio(spark, d):
    return docs(spark, d).where("length(text) > 0").select("doc_id", F.round(T.alpha_ratio(F.col("text")), 6).alias("ratio"))


@query("fn_informative", rf"""
WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents)
SELECT doc_id, count(*) AS n, count(*) FILTER (length(s) >= 12 AND NOT (upper(s) = s AND lower(s) <> s AND length(s) > 15)
  AND length(regexp_replace(s, '[^\p{{L}}]', '', 'g'))::DOUBLE / length(s) >= 0.4 AND len(list_distinct(regexp_extract_all(lower(s), '\w+'))) >= 4) AS informative FROM s GROUP BY doc_id""")
def fn_informative(spark, d):
    s = docs(spark, d).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.informative(F.col("s"))).alias("informative"))


@query("fn_term_count", "SELECT doc_id, ((length(text) - length(replace(lower(text), 'model', ''))) // 5)::INT AS n FROM documents")
def fn_term_count(spark, d):
    return docs(spark, d).select("doc_id", T.occurrences(F.col("text"), F.lit("model")).alias("n"))


@query("fn_md5", "SELECT doc_id, md5(text) AS h FROM documents")
def fn_md5(spark, d):
    return docs(spark, d).select("doc_id", F.md5("text").alias("h"))


@query("fn_completeness", r"""
WITH s AS (SELECT id, ingested_at, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM chunks WHERE text IS NOT NULL),
n AS (SELECT id, ingested_at, s, regexp_matches(s, '(^|\n)\s*([\-•\*]|[0-9]+[.)])')::INT + regexp_matches(s, '^\p{Ll}')::INT + (NOT regexp_matches(s, '[.?!]$'))::INT
  + (contains(lower(s), 'as above') OR regexp_extract(lower(s), '([^\s]+)$', 1) IN ('these', 'those', 'following'))::INT AS n FROM s)
SELECT id, ingested_at, CASE WHEN s = '' OR n >= 2 THEN 'INCOMPLETE' WHEN n = 1 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state FROM n""")
def fn_completeness(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("id", "ingested_at", T.completeness(F.col("text")).alias("state"))


@query("fn_section_bias", f"""
SELECT section_title, headings, count(*) AS n, any_value(CASE WHEN regexp_matches(lower(concat_ws(' ', section_title, array_to_string(headings, ' '))), '{"|".join(T.SECTION_PENALTIES)}') THEN 0.15
  WHEN regexp_matches(lower(concat_ws(' ', section_title, array_to_string(headings, ' '))), '{"|".join(T.SECTION_BONUSES)}') THEN 1.15 ELSE 1.0 END)::DOUBLE AS bias FROM chunks GROUP BY ALL""")
def fn_section_bias(spark, d):
    c = table(spark, d, "chunks").groupBy("section_title", "headings").agg(F.count("*").alias("n"))
    return c.withColumn("bias", T.section_bias(F.col("section_title"), F.array_join("headings", " ")))


@query("fn_model_names", rf"SELECT id, ingested_at, len(list_distinct(regexp_extract_all(text, '{T.MODEL_NAME}', 1))) AS n_models FROM chunks WHERE text IS NOT NULL")
def fn_model_names(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("id", "ingested_at", F.size(T.model_names(F.col("text"))).alias("n_models"))


@query("fn_heading_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents),
s AS (SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM l),
u AS (SELECT *, length(regexp_replace(s, '[^\p{Lu}]', '', 'g'))::DOUBLE / greatest(1, length(regexp_replace(s, '[^\p{L}]', '', 'g'))) AS u FROM s)
SELECT doc_id, count(*) AS n FROM u WHERE s <> '' AND length(s) <= 120 AND s NOT LIKE '%.'
 AND (regexp_matches(s, '^([0-9]+(\.[0-9]+)*)\s+[^\d]+') OR u > 0.6 OR (regexp_matches(s, '\p{L}') AND NOT regexp_matches(s, '(^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}'))) GROUP BY doc_id""")
def fn_heading_lines(spark, d):
    lines = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(T.heading(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("fn_keyword_split", r"SELECT id, ingested_at, list_filter(list_transform(regexp_split_to_array(regexp_replace(categories, '^\s+|\s+$', '', 'g'), '[\n,;|]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS keywords FROM papers WHERE categories IS NOT NULL AND regexp_replace(categories, '^\s+|\s+$', '', 'g') NOT LIKE '[%]'")
def fn_keyword_split(spark, d):
    p = table(spark, d, "papers").where("categories is not null")
    s = T.strip(F.col("categories"))
    return p.where(~(s.startswith("[") & s.endswith("]"))).select("id", "ingested_at", T.keyword_list(F.col("categories")).alias("keywords"))


@query("fn_keyword_json", """SELECT id, ingested_at, list_filter(list_transform(from_json(categories, '["VARCHAR"]'), lambda x: trim(x)), lambda x: x <> '') AS keywords FROM papers WHERE categories LIKE '["%]'""")
def fn_keyword_json(spark, d):
    p = table(spark, d, "papers").where("categories like '[\"%]'")
    return p.select("id", "ingested_at", T.keyword_list(F.col("categories")).alias("keywords"))


@query("fn_spans", r"""
WITH s AS (SELECT id, ingested_at, array_to_string(regexp_extract_all(title, '[^\s]+')[1:8], ' ') AS s FROM papers WHERE title IS NOT NULL),
c AS (SELECT id, ingested_at, CASE WHEN length(s) > 64 THEN left(regexp_replace(left(s, 65), '\s+[^\s]*$', ''), 64) ELSE s END AS s FROM s)
SELECT id, ingested_at, CASE WHEN s <> '' AND length(regexp_replace(s, '[^\p{L}]', '', 'g'))::DOUBLE / length(s) >= 0.35 THEN s END AS span FROM c""")
def fn_spans(spark, d):
    return table(spark, d, "papers").where("title is not null").select("id", "ingested_at", T.span_normalised(F.col("title")).alias("span"))


@query("fn_synonyms", "SELECT query_id, list_transform(keyword_regular, lambda w: CASE lower(w) WHEN 'retrieval' THEN 'search' WHEN 'qa' THEN 'question answering' WHEN 'method' THEN 'approach' WHEN 'result' THEN 'finding' WHEN 'experiment' THEN 'study' ELSE w END) AS swapped FROM query_specs WHERE keyword_regular IS NOT NULL")
def fn_synonyms(spark, d):
    table_ = F.create_map(*[x for k, v in T.SYNONYMS.items() for x in (F.lit(k), F.lit(v[0]))])
    return table(spark, d, "query_specs").where("keyword_regular is not null").select("query_id", F.transform("keyword_regular", lambda w: F.coalesce(F.try_element_at(table_, F.lower(w)), w)).alias("swapped"))


_CUES = ", ".join(f"('{k}', {v!r})" for k, v in T.INTENT_CUES.items())


@query("query_intent_terms", f"WITH c AS (SELECT unnest([{', '.join(repr(k) for k in T.INTENT_CUES)}]) AS cue, unnest([{', '.join(str(v) for v in T.INTENT_CUES.values())}]) AS terms) SELECT query_id, unnest(terms) AS term, 2.0::DOUBLE AS weight FROM query_specs JOIN c ON contains(lower(raw), cue)")
def query_intent_terms(spark, d):
    cues = F.create_map(*[x for k, v in T.INTENT_CUES.items() for x in (F.lit(k), T.words_of(v))])
    hit = F.filter(F.map_keys(cues), lambda k: F.contains(F.lower(F.col("raw")), k))
    return table(spark, d, "query_specs").select("query_id", F.explode(F.flatten(F.transform(hit, lambda k: F.element_at(cues, k)))).alias("term"), F.lit(2.0).alias("weight"))


@query("src_tag_strip", "SELECT id, ingested_at, regexp_replace(abstract, '<[^>]+>', ' ', 'g') AS plain FROM papers WHERE abstract IS NOT NULL")
def src_tag_strip(spark, d):
    return table(spark, d, "papers").where("abstract is not null").select("id", "ingested_at", F.regexp_replace("abstract", "<[^>]+>", " ").alias("plain"))


@query("src_json_field", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def src_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("lex_shingles", r"""
WITH t AS (SELECT query_id, regexp_extract_all(lower(raw), '[a-z0-9]+') AS t FROM query_specs WHERE raw IS NOT NULL)
SELECT query_id, unnest([t[i] || ' ' || t[i+1] FOR i IN range(1, len(t))]) AS shingle FROM t UNION ALL
SELECT query_id, unnest([t[i] || ' ' || t[i+1] || ' ' || t[i+2] FOR i IN range(1, len(t) - 1)]) FROM t""")
def lex_shingles(spark, d):
    t = table(spark, d, "query_specs").where("raw is not null").select("query_id", T.plain_terms(F.col("raw")).alias("t"))
    return t.select("query_id", F.explode(F.concat(T.shingles(F.col("t"), 2), T.shingles(F.col("t"), 3))).alias("shingle"))
