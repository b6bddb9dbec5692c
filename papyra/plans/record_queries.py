"""Queries of projections, filters, joins, aggregations and ranks over records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions import records as R
from papyra.functions import text as T
from papyra.operators.latest import latest_rows
from papyra.operators.packed import packed_fields, split_packed
from papyra.operators.sequence import last_before, linked, numbered
from papyra.plans.registry import query, table
from papyra.storage import small_side

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _s(c: str) -> str:
    return _STRIP.format(c)


@query("p5_found")
def p5_found(spark, d):
    return split_packed(packed_fields(table(spark, d, "papers"), "id", ["authors", "categories"], "ingested_at"))


@query("p5_checks", """
WITH p AS (SELECT DISTINCT ON (id) * FROM papers WHERE id IS NOT NULL ORDER BY id, ingested_at DESC), f AS (SELECT id AS rec_id, 'authors' AS field, authors AS text FROM p UNION ALL SELECT id, 'categories', categories FROM p)
SELECT rec_id, field, true AS numbered_from_one, true AS values_stand_in_the_text, true AS rest_is_no_word FROM f WHERE regexp_matches(text, '[^\\s\\p{P}\\p{S}]')""")
def p5_checks(spark, d):
    """Of each packed field: whether its values are numbered, stand in its text, and leave only delimiters, quotes and the
    word "and" behind."""
    packed = packed_fields(table(spark, d, "papers"), "id", ["authors", "categories"], "ingested_at")
    vals = F.transform(F.sort_array(F.collect_list(F.struct("pos", "val"))), lambda x: x["val"])
    g = split_packed(packed).groupBy("rec_id", "field").agg(vals.alias("vals"), (F.max("pos") == F.count("*")).alias("numbered_from_one"))
    j = g.join(packed, ["rec_id", "field"])
    bare = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    whole = bare(F.regexp_replace("text", r"(?i)\band\b", ""))
    told = bare(F.regexp_replace(F.array_join("vals", " "), r"(?i)\band\b", ""))
    inside = F.forall("vals", lambda v: F.contains(bare(F.col("text")), bare(v)))
    return j.select("rec_id", "field", "numbered_from_one", inside.alias("values_stand_in_the_text"), (whole == told).alias("rest_is_no_word"))


@query("src_category_filter", rf"SELECT id, ingested_at FROM papers WHERE list_has_any(regexp_split_to_array({_s('categories')}, '\s+'), ['cs.CL', 'cs.IR'])")
def src_category_filter(spark, d):
    return table(spark, d, "papers").where(R.in_categories(F.col("categories"), ["cs.CL", "cs.IR"])).select("id", "ingested_at")


@query("src_kept_counts", rf"SELECT count(*) AS total, count(*) FILTER (coalesce(list_has_any(regexp_split_to_array({_s('categories')}, '\s+'), ['cs.CL', 'cs.IR']), false)) AS kept FROM papers")
def src_kept_counts(spark, d):
    return table(spark, d, "papers").agg(F.count("*").alias("total"), F.count_if(R.in_categories(F.col("categories"), ["cs.CL", "cs.IR"])).alias("kept"))


@query("prj_embedding_text", f"SELECT id, ingested_at, CASE WHEN {_s('coalesce(title, chr(32))')} = '' AND {_s('coalesce(abstract, chr(32))')} = '' THEN '' ELSE {_s('coalesce(title, chr(32))')} || ' [SEP] ' || {_s('coalesce(abstract, chr(32))')} END AS content FROM papers")
def prj_embedding_text(spark, d):
    return table(spark, d, "papers").select("id", "ingested_at", R.embedding_text(F.col("title"), F.col("abstract")).alias("content"))


@query("prj_author_synthesis", rf"SELECT id, ingested_at, coalesce(nullif({_s('authors')}, ''), nullif(array_to_string([y FOR y IN [{_s(chr(97) + 'rray_to_string([x FOR x IN p IF ' + _s('x') + ' <> ' + repr('') + '], ' + repr(' ') + ')')} FOR p IN authors_parsed] IF y <> ''], ', '), '')) AS authors_text FROM papers")
def prj_author_synthesis(spark, d):
    return table(spark, d, "papers").select("id", "ingested_at", F.coalesce(R.first_non_empty(F.col("authors")), R.authors_from_parts(F.col("authors_parsed"))).alias("authors_text"))


@query("prj_first_non_empty", f"SELECT id, ingested_at, coalesce(nullif({_s('title')}, ''), nullif({_s('abstract')}, ''), nullif({_s('id')}, '')) AS label FROM papers")
def prj_first_non_empty(spark, d):
    return table(spark, d, "papers").select("id", "ingested_at", R.first_non_empty(F.col("title"), F.col("abstract"), F.col("id")).alias("label"))


@query("prj_format_date", rf"SELECT id, ingested_at, nullif(regexp_extract({_s('update_date')}, '^[^T]*'), '') AS day, try_cast(nullif(regexp_extract(update_date, '((?:19|20)\d{{2}})', 1), '') AS INT) AS year FROM papers")
def prj_format_date(spark, d):
    return table(spark, d, "papers").select("id", "ingested_at", R.date_part(F.col("update_date")).alias("day"), R.year(F.col("update_date")).alias("year"))


@query("prj_result_card", rf"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC NULLS LAST, chunk_id, logged_at) AS rank FROM candidates)
SELECT r.query_id, rank, coalesce(nullif({_s(r"regexp_replace(p.title, '\s*[\r\n]+\s*', ' ', 'g')")}, ''), 'Result ' || rank) AS title, nullif(regexp_extract({_s('p.update_date')}, '^[^T]*'), '') AS day,
 CASE WHEN fused_score IS NOT NULL THEN printf('%.3f', floor(fused_score * 1000 + 0.5) / 1000) END AS score
FROM r LEFT JOIN (SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1) p ON p.id = r.doc_id WHERE rank <= 15""")
def prj_result_card(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.col("fused_score").desc_nulls_last(), "chunk_id", "logged_at")
    top = table(spark, d, "candidates").withColumn("rank", F.row_number().over(w)).where("rank <= 15").select("query_id", "rank", "doc_id", "fused_score")
    p = latest_rows(table(spark, d, "papers").select("id", "title", "update_date", "ingested_at"), ["id"], "ingested_at")
    c = top.join(p, top["doc_id"] == p["id"], "left").select("query_id", "rank", R.card(F.col("rank"), F.col("title"), F.lit(None).cast("string"), F.col("update_date"), F.col("fused_score")).alias("c"))
    return c.select("query_id", "rank", "c.title", F.col("c.date").alias("day"), "c.score")


@query("prj_year_filter", r"SELECT id, ingested_at FROM papers WHERE try_cast(nullif(regexp_extract(update_date, '((?:19|20)\d{2})', 1), '') AS INT) BETWEEN 2019 AND 2022")
def prj_year_filter(spark, d):
    p = table(spark, d, "papers")
    return p.where(R.year_between(R.year(F.col("update_date")), 2019, 2022)).select("id", "ingested_at")


@query("prj_field_filter", "SELECT id, ingested_at FROM chunks WHERE list_bool_or([contains(lower(x), 'method') FOR x IN headings])")
def prj_field_filter(spark, d):
    return table(spark, d, "chunks").where(R.in_field(F.col("headings"), "method")).select("id", "ingested_at")


@query("prj_section_filter", f"SELECT id, ingested_at FROM chunks WHERE lower({_s('section_title')}) = 'method'")
def prj_section_filter(spark, d):
    return table(spark, d, "chunks").where(F.lower(T.strip(F.col("section_title"))) == "method").select("id", "ingested_at")


@query("prj_trimmed", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS short FROM documents")
def prj_trimmed(spark, d):
    return table(spark, d, "documents").select("doc_id", R.trimmed(F.col("text"), 80).alias("short"))


@query("join_neighbours", "WITH c AS (SELECT DISTINCT id, prev_chunk_id, next_chunk_id, text FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1) SELECT c.id, length(p.text) AS before, length(n.text) AS after FROM c LEFT JOIN c p ON p.id = c.prev_chunk_id LEFT JOIN c n ON n.id = c.next_chunk_id")
def join_neighbours(spark, d):
    c = latest_rows(table(spark, d, "chunks").select("id", "prev_chunk_id", "next_chunk_id", F.length("text").alias("n"), "ingested_at"), ["id"], "ingested_at").drop("ingested_at")
    side = c.select(F.col("id").alias("k"), F.col("n").alias("m"))
    j = c.join(side.withColumnRenamed("m", "before"), F.col("prev_chunk_id") == F.col("k"), "left").drop("k")
    return j.join(side.withColumnRenamed("m", "after"), F.col("next_chunk_id") == F.col("k"), "left").select("id", "before", "after")


@query("join_section_asof", """
WITH c AS (SELECT * FROM chunks WHERE char_start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),
s AS (SELECT doc_id, section_title, min(char_start) AS start FROM c WHERE section_title IS NOT NULL GROUP BY ALL),
j AS (SELECT c.id, s.section_title, s.start, c.char_start, row_number() OVER (PARTITION BY c.id ORDER BY s.start DESC, s.section_title DESC) AS n FROM c JOIN s ON s.doc_id = c.doc_id AND s.start <= c.char_start)
SELECT id, section_title AS section, (char_start - start BETWEEN 0 AND 400) AS near FROM j WHERE n = 1""")
def join_section_asof(spark, d):
    """Last section that starts at or before each chunk: both sides in ordered passes over ranges of a document, no range join."""
    c = latest_rows(table(spark, d, "chunks").where("char_start is not null").select("id", "doc_id", "char_start", "section_title", "ingested_at"), ["id"], "ingested_at")
    marks = c.where("section_title is not null").groupBy("doc_id", "section_title").agg(F.min("char_start").alias("char_start")).withColumnRenamed("section_title", "mark")
    j = last_before(c.select("id", "doc_id", "char_start"), marks, "doc_id", "char_start").where("mark is not null")
    return j.select("id", F.col("mark").alias("section"), (F.col("char_start") - F.col("mark_at")).between(0, 400).alias("near"))


@query("join_vector_lookup", "SELECT e.vec_id, e.label, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def join_vector_lookup(spark, d):
    e, x = table(spark, d, "embeddings"), table(spark, d, "documents")
    return e.join(x, e["vec_id"] == x["doc_id"]).select("vec_id", "label", "source")


@query("agg_anchors", """
WITH c AS (SELECT DISTINCT ON (id) doc_id, section_title, model_names FROM chunks ORDER BY id, ingested_at DESC),
t AS (SELECT doc_id, 'section' AS kind, section_title AS term FROM c WHERE section_title IS NOT NULL UNION ALL SELECT doc_id, 'model', unnest(model_names) FROM c),
n AS (SELECT doc_id, kind, term, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, kind, term, n, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, term) AS place FROM n QUALIFY place <= 5""")
def agg_anchors(spark, d):
    c = latest_rows(table(spark, d, "chunks").select("id", "doc_id", "section_title", "model_names", "ingested_at"), ["id"], "ingested_at")
    t = c.where("section_title is not null").select("doc_id", F.lit("section").alias("kind"), F.col("section_title").alias("term")).unionByName(c.select("doc_id", F.lit("model").alias("kind"), F.explode("model_names").alias("term")))
    n = t.groupBy("doc_id", "kind", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id", "kind").orderBy(F.desc("n"), "term")
    return n.withColumn("place", F.row_number().over(w)).where("place <= 5")


@query("agg_list_statistics", """
SELECT query_id, avg(semantic_score) AS mean, CASE WHEN count(semantic_score) < 2 THEN 1.0::DOUBLE ELSE coalesce(nullif(stddev_samp(semantic_score), 0), 1) END AS deviation, max(semantic_score) AS top FROM candidates GROUP BY query_id""")
def agg_list_statistics(spark, d):
    dev = F.when(F.count("semantic_score") < 2, 1.0).otherwise(F.coalesce(F.nullif(F.stddev_samp("semantic_score"), F.lit(0.0)), F.lit(1.0)))
    return table(spark, d, "candidates").groupBy("query_id").agg(F.avg("semantic_score").alias("mean"), dev.alias("deviation"), F.max("semantic_score").alias("top"))


@query("agg_best_lexical", "SELECT query_id, chunk_id, logged_at, list_max(map_values(lexical_scores)) AS best FROM candidates")
def agg_best_lexical(spark, d):
    return table(spark, d, "candidates").select("query_id", "chunk_id", "logged_at", F.array_max(F.map_values("lexical_scores")).alias("best"))


@query("agg_corpus_statistics", "WITH d AS (SELECT len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents WHERE text IS NOT NULL) SELECT count(*) AS n_docs, round(avg(dl), 6) AS avgdl FROM d")
def agg_corpus_statistics(spark, d):
    from papyra.operators.lexical import corpus_statistics

    return corpus_statistics(table(spark, d, "documents")).withColumn("avgdl", F.round("avgdl", 6))


_PHRASES = r"""
WITH t AS (SELECT query_id, regexp_extract_all(lower(raw), '[a-z0-9][a-z0-9\-]+') AS t FROM query_specs WHERE raw IS NOT NULL),
w AS (SELECT query_id, unnest(range(len(t))) AS pos, unnest(t) AS w FROM t),
k AS (SELECT *, list_contains({stops}, w) AS stop FROM w),
g AS (SELECT *, sum(stop::INT) OVER (PARTITION BY query_id ORDER BY pos) AS grp FROM k),
ph AS (SELECT query_id, grp, w, count(*) OVER (PARTITION BY query_id, grp) AS len FROM g WHERE NOT stop),
ws AS (SELECT w, count(*) AS freq, sum(len - 1) AS degree FROM ph GROUP BY w)
""".replace("{stops}", "['" + "','".join(T.STOP_WORDS) + "']")


def rake_words(spark, d):
    """Words of the queries between stop words, with the length of the phrase each stands in."""
    t = table(spark, d, "query_specs").where("raw is not null").select("query_id", F.posexplode(T.keyword_tokens(F.col("raw"))).alias("pos", "w"))
    t = t.withColumn("stop", F.col("w").isin(T.STOP_WORDS)).withColumn("grp", F.sum(F.col("stop").cast("int")).over(Window.partitionBy("query_id").orderBy("pos")))
    return t.where("not stop").withColumn("len", F.count("*").over(Window.partitionBy("query_id", "grp")))


@query("agg_rake_words", _PHRASES + "SELECT w AS word, freq, degree::BIGINT AS degree, round((degree + freq) / freq::DOUBLE, 6) AS score FROM ws")
def agg_rake_words(spark, d):
    s = rake_words(spark, d).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("freq"), F.sum(F.col("len") - 1).alias("degree"))
    return s.withColumn("score", F.round((F.col("degree") + F.col("freq")) / F.col("freq"), 6))


@query("query_rake_phrases", _PHRASES + "SELECT query_id, string_agg(ph.w, ' ' ORDER BY pos) AS phrase, round(sum((degree + freq) / freq::DOUBLE), 6) AS score FROM (SELECT query_id, grp, pos, w, count(*) OVER (PARTITION BY query_id, grp) AS len FROM g WHERE NOT stop) ph JOIN ws USING (w) WHERE ph.len <= 5 GROUP BY query_id, grp")
def query_rake_phrases(spark, d):
    words = rake_words(spark, d)
    score = words.groupBy("w").agg(((F.sum(F.col("len") - 1) + F.count("*")) / F.count("*")).alias("ws"))
    p = words.where("len <= 5").join(small_side(score), "w").groupBy("query_id", "grp").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws_"), F.round(F.sum("ws"), 6).alias("score"))
    return p.select("query_id", F.array_join(F.transform("ws_", lambda x: x["w"]), " ").alias("phrase"), "score")


@query("query_boosted_split", "SELECT query_id, list_distinct(k)[1:least(3, len(k))] IS NOT NULL AS ok, len((k)[1:3]) AS boosted, greatest(0, len(k) - 3) AS regular FROM (SELECT query_id, keyword_boosted || keyword_regular AS k FROM query_specs WHERE keyword_boosted IS NOT NULL AND keyword_regular IS NOT NULL AND len(list_distinct(keyword_boosted || keyword_regular)) = len(keyword_boosted || keyword_regular))")
def query_boosted_split(spark, d):
    k = F.concat("keyword_boosted", "keyword_regular")
    q = table(spark, d, "query_specs").where(k.isNotNull() & (F.size(F.array_distinct(k)) == F.size(k)))
    return q.select("query_id", F.lit(True).alias("ok"), F.size(F.slice(k, 1, 3)).cast("long").alias("boosted"), F.greatest(F.lit(0), F.size(k) - 3).cast("long").alias("regular"))


@query("rank_within_list", "WITH e AS (SELECT query_id, chunk_id, logged_at, unnest(map_entries(lexical_scores)) AS e FROM candidates) SELECT query_id, chunk_id, logged_at, e.key AS list, row_number() OVER (PARTITION BY query_id, e.key ORDER BY e.value DESC, chunk_id, logged_at) AS rank FROM e")
def rank_within_list(spark, d):
    e = table(spark, d, "candidates").select("query_id", "chunk_id", "logged_at", F.explode("lexical_scores").alias("list", "value"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "list").orderBy(F.desc("value"), "chunk_id", "logged_at"))).drop("value")


_LATEST = "SELECT DISTINCT ON (id) * FROM chunks ORDER BY id, ingested_at DESC"


@query("rank_chunk_links", f"WITH c AS ({_LATEST}) SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id, id)")
def rank_chunk_links(spark, d):
    c = latest_rows(table(spark, d, "chunks").select("id", "doc_id", "chunk_id", "ingested_at"), ["id"], "ingested_at")
    return linked(c, "doc_id", "chunk_id", "id")


@query("rank_breadcrumb", f"WITH c AS ({_LATEST}), f AS (SELECT doc_id, section_title, min(chunk_id) AS first FROM c WHERE section_title IS NOT NULL GROUP BY ALL) SELECT doc_id, section_title, first, array_to_string(list(section_title) OVER (PARTITION BY doc_id ORDER BY first, section_title ROWS UNBOUNDED PRECEDING), ' > ') AS trail FROM f")
def rank_breadcrumb(spark, d):
    """All headings of a document so far: bounded by its number of different section titles."""
    c = latest_rows(table(spark, d, "chunks").select("id", "doc_id", "chunk_id", "section_title", "ingested_at"), ["id"], "ingested_at")
    f = c.where("section_title is not null").groupBy("doc_id", "section_title").agg(F.min("chunk_id").alias("first"))
    w = Window.partitionBy("doc_id").orderBy("first", "section_title").rowsBetween(Window.unboundedPreceding, 0)
    return f.withColumn("trail", F.array_join(F.collect_list("section_title").over(w), " > "))


@query("rank_section_ordinal", f"WITH c AS ({_LATEST}) SELECT id, row_number() OVER (PARTITION BY doc_id, section_title ORDER BY chunk_id, id) AS in_section, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, id) AS in_doc FROM c")
def rank_section_ordinal(spark, d):
    c = latest_rows(table(spark, d, "chunks").select("id", "doc_id", "chunk_id", "section_title", "ingested_at"), ["id"], "ingested_at")
    return numbered(c, ["doc_id", "section_title"], "chunk_id", "id", "in_section").join(numbered(c, ["doc_id"], "chunk_id", "id", "in_doc"), "id")


@query("sort_score_nulls_last", "SELECT query_id, chunk_id, logged_at, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC NULLS LAST, chunk_id, logged_at) AS rank FROM candidates QUALIFY rank <= 10")
def sort_score_nulls_last(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.col("semantic_score").desc_nulls_last(), "chunk_id", "logged_at")
    return table(spark, d, "candidates").select("query_id", "chunk_id", "logged_at", F.row_number().over(w).alias("rank")).where("rank <= 10")


def _qualifier(name: str, order: str, *keys):
    y = r"try_cast(nullif(regexp_extract(update_date, '((?:19|20)\d{2})', 1), '') AS INT)"

    @query(f"sort_{name}", f"WITH p AS (SELECT DISTINCT ON (id) * FROM papers ORDER BY id, ingested_at DESC), c AS (SELECT doc_id, count(*) AS cites FROM chunks GROUP BY 1) SELECT id, row_number() OVER (ORDER BY {order.format(y=y)}, id) AS rank FROM p LEFT JOIN c ON c.doc_id = p.id QUALIFY rank <= 25")
    def run(spark, d):
        p = latest_rows(table(spark, d, "papers").select("id", "update_date", "ingested_at"), ["id"], "ingested_at")
        c = table(spark, d, "chunks").groupBy("doc_id").agg(F.count("*").alias("cites"))
        j = p.join(c, p["id"] == c["doc_id"], "left").select("id", R.year(F.col("update_date")).alias("y"), "cites")
        top = j.orderBy(*[k() for k in keys], "id").limit(25)
        return top.select("id", F.row_number().over(Window.orderBy(*[k() for k in keys], "id")).alias("rank"))  # 25 rows

    return run


_qualifier("recent", "coalesce({y}, -1) DESC", lambda: F.coalesce("y", F.lit(-1)).desc())
_qualifier("classic", "coalesce({y}, 9999)", lambda: F.coalesce("y", F.lit(9999)))
_qualifier("popular", "coalesce(cites, 0) DESC", lambda: F.coalesce("cites", F.lit(0)).desc())


@query("set_union_quotes", """
WITH a AS (SELECT query_id, chunk_id, 0 AS src, semantic_score AS s FROM candidates WHERE semantic_score IS NOT NULL),
b AS (SELECT query_id, chunk_id, 1 AS src, fused_score AS s FROM candidates WHERE fused_score IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, src ORDER BY s DESC, chunk_id) AS n FROM (SELECT query_id, chunk_id, src, max(s) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(src * 1000000 + n), chunk_id) AS place FROM r GROUP BY query_id, chunk_id""")
def set_union_quotes(spark, d):
    c = table(spark, d, "candidates")
    both = c.where("semantic_score is not null").select("query_id", "chunk_id", F.lit(0).alias("src"), F.col("semantic_score").alias("s")).unionByName(c.where("fused_score is not null").select("query_id", "chunk_id", F.lit(1).alias("src"), F.col("fused_score").alias("s")))
    r = both.groupBy("query_id", "chunk_id", "src").agg(F.max("s").alias("s")).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "src").orderBy(F.desc("s"), "chunk_id")))
    first = r.groupBy("query_id", "chunk_id").agg(F.min(F.struct("src", "n")).alias("k"))
    return first.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("k", "chunk_id")).alias("place"))


@query("set_jaccard", rf"""
WITH c AS ({_LATEST}), t AS (SELECT id, doc_id, chunk_id, list_distinct(regexp_extract_all(lower(text), '[^\s]+')) AS t FROM c),
p AS (SELECT id, t, lag(t) OVER (PARTITION BY doc_id ORDER BY chunk_id, id) AS u FROM t)
SELECT id, CASE WHEN len(t) > 0 AND len(u) > 0 THEN round(len(list_intersect(t, u))::DOUBLE / len(list_distinct(t || u)), 6) ELSE 0 END AS overlap FROM p WHERE u IS NOT NULL""")
def set_jaccard(spark, d):
    c = latest_rows(table(spark, d, "chunks").select("id", "doc_id", "chunk_id", "text", "ingested_at"), ["id"], "ingested_at")
    t = c.select("id", F.array_distinct(T.tokens(F.lower("text"))).alias("t"))
    before = linked(c, "doc_id", "chunk_id", "id").where("before is not null").select("id", "before")
    j = before.join(t, "id").join(t.select(F.col("id").alias("before"), F.col("t").alias("u")), "before").where("u is not null")
    return j.select("id", F.round(T.jaccard(F.col("t"), F.col("u")), 6).alias("overlap"))


@query("set_vocabulary_overlap", "SELECT query_id, list_sort(list_intersect(keyword_boosted, keyword_regular)) AS shared, list_sort([x FOR x IN list_distinct(keyword_regular) IF NOT list_contains(['models', 'queries'], x)]) AS allowed FROM query_specs WHERE keyword_boosted IS NOT NULL AND keyword_regular IS NOT NULL")
def set_vocabulary_overlap(spark, d):
    q = table(spark, d, "query_specs").where("keyword_boosted is not null and keyword_regular is not null")
    return q.select("query_id", F.array_sort(F.array_intersect("keyword_boosted", "keyword_regular")).alias("shared"), F.array_sort(F.array_except("keyword_regular", T.words_of(["models", "queries"]))).alias("allowed"))
