"""Queries of sources, sinks and indexes: what is written must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import records as R
from papyra.functions import text as T
from papyra.models import HashEmbedder
from papyra.operators import ingest
from papyra.operators.latest import latest_rows
from papyra.plans.registry import query, table
from papyra.plans.text_queries import _SENTENCES
from papyra.sources import index as X
from papyra.sources import papers as S
from papyra.sources.tei import tei_rows
from papyra.storage import stage, staged_path

_COLS = "id, title, abstract, authors, authors_parsed, categories, update_date"
_LATEST = "SELECT DISTINCT ON (id) * FROM chunks WHERE id IS NOT NULL ORDER BY id, ingested_at DESC"


def _json_lines(spark, d, *extra: str) -> str:
    """The papers as JSON lines, with these lines among them."""
    lines = table(spark, d, "papers").select(F.to_json(F.struct(*_COLS.split(", "))).alias("value"))
    for e in extra:
        lines = lines.unionByName(spark.range(1).select(F.lit(e).alias("value")))
    path = staged_path(spark, "json-lines")
    lines.write.text(path)
    return path


@query("src_jsonl_scan", f"SELECT {_COLS} FROM papers")
def src_jsonl_scan(spark, d):
    """JSON lines among which some are blank, malformed or no object."""
    return S.read_papers(spark, _json_lines(spark, d, "", "   ", '{"id": "broken', "[1, 2]")).where("id is not null")


@query("src_jsonl_strict", r"SELECT id, title, regexp_replace(abstract, '^\s+|\s+$', '', 'g') AS abstract FROM papers")
def src_jsonl_strict(spark, d):
    return S.read_papers(spark, _json_lines(spark, d), strict=True).select("id", "title", "abstract")


def _payload(first: str, second: str, third: str) -> str:
    one = lambda c: rf"nullif(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '')"
    return f"SELECT id, ingested_at, coalesce({one(first)}, {one(second)}, {one(third)}) AS text FROM papers"


@query("src_payload_text", _payload("authors", "abstract", "title"))
def src_payload_text(spark, d):
    raw = F.to_json(F.struct(F.col("authors").alias("processed_text"), F.col("abstract").alias("full_text"), F.col("title").alias("summary")))
    return table(spark, d, "papers").select("id", "ingested_at", S.payload_text(raw).alias("text"))


@query("src_payload_summary", r"SELECT id, ingested_at, coalesce(nullif(regexp_replace(abstract, '^\s+|\s+$', '', 'g'), ''), nullif(regexp_replace(title, '^\s+|\s+$', '', 'g'), '')) AS text FROM papers")
def src_payload_summary(spark, d):
    raw = F.to_json(F.struct(F.col("authors").alias("processed_text"), F.col("abstract").alias("full_text"), F.col("title").alias("summary")))
    return table(spark, d, "papers").select("id", "ingested_at", S.payload_text(raw, "full_text", "summary").alias("text"))


_TEI = rf"""
WITH c AS ({_LATEST}), x AS (SELECT id, nullif(regexp_replace(section_title, '^\s+|\s+$', '', 'g'), '') AS section, replace(text, chr(13), chr(10)) AS text FROM c WHERE text IS NOT NULL),
s AS (SELECT id, section, {_SENTENCES} AS s FROM x)
SELECT id AS path, printf('s%04d-%04d', CASE WHEN section IS NULL THEN 0 ELSE 1 END, n) AS sentence_id, s[n] AS text, section, (n - 1)::INT AS "order" FROM (SELECT id, section, s, unnest(range(1, len(s) + 1)) AS n FROM s)"""


def _tei(spark, d):
    """Each chunk as a small TEI file: its section title as head, its text as paragraph."""
    c = latest_rows(table(spark, d, "chunks").select("id", "section_title", "text", "ingested_at"), ["id"], "ingested_at").where("text is not null")
    safe = lambda x: F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>'), safe(F.col("section_title")), F.lit("</head><p>"), safe(F.col("text")), F.lit("</p></div></body></text></TEI>"))
    return c.select(F.col("id").alias("path"), xml.alias("xml"))


@query("src_tei_sentences", _TEI)
def src_tei_sentences(spark, d):
    return tei_rows(_tei(spark, d))


@query("src_default_fill", "SELECT id, ingested_at, coalesce(title, '') AS title, coalesce(categories, 'none') AS categories, '' AS doi FROM papers")
def src_default_fill(spark, d):
    return S.with_defaults(table(spark, d, "papers").select("id", "ingested_at", "title", "categories"), {"title": "", "categories": "none", "doi": ""})


@query("sink_report", "SELECT query_id::VARCHAR || ' ' || raw AS line FROM query_specs WHERE raw IS NOT NULL")
def sink_report(spark, d):
    """A text report, read again."""
    path = staged_path(spark, "report")
    q = table(spark, d, "query_specs").where("raw is not null").select(F.concat_ws(" ", F.col("query_id").cast("string"), "raw").alias("line"))
    S.write_report(q, path, "line")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("sink_kept_papers", r"SELECT id, title FROM papers WHERE list_has_any(regexp_split_to_array(regexp_replace(categories, '^\s+|\s+$', '', 'g'), '\s+'), ['cs.CL', 'cs.IR'])")
def sink_kept_papers(spark, d):
    """The filtered copy as JSON lines, read again."""
    path = staged_path(spark, "kept")
    S.copy_filtered(table(spark, d, "papers"), path, ["cs.CL", "cs.IR"])
    return S.read_papers(spark, path).select("id", "title")


def _index(spark, d):
    """Every chunk's first delivery as an index, the later ones added as a generation."""
    c = table(spark, d, "chunks").where("id is not null").select("id", "doc_id", "text", "section_title", "ingested_at")
    first = c.groupBy("id").agg(F.min("ingested_at").alias("first"))
    j = stage(c.join(first, "id"), "index-chunks")
    path = staged_path(spark, "index")
    X.create_index(j.where("ingested_at = first").drop("first").withColumn("generation", F.lit("a")), path, extra_settings={"similarity": {"k1": 1.2}})
    X.upsert(spark, path, j.where("ingested_at > first").drop("first"), "b")
    return path


@query("idx_upsert_current", f"SELECT id, doc_id, text, section_title FROM ({_LATEST})")
def idx_upsert_current(spark, d):
    return X.current(spark, _index(spark, d)).select("id", "doc_id", "text", "section_title")


@query("idx_lookup", f"WITH c AS ({_LATEST}), w AS (SELECT DISTINCT chunk_id AS id FROM candidates UNION SELECT 'nowhere') SELECT w.id, c.text FROM w LEFT JOIN c ON c.id = w.id")
def idx_lookup(spark, d):
    wanted = table(spark, d, "candidates").select(F.col("chunk_id").alias("id")).unionByName(spark.range(1).select(F.lit("nowhere").alias("id"))).distinct()
    return X.fetch_many(spark, _index(spark, d), wanted).select("id", "text")


@query("idx_lifecycle", "SELECT true AS created, 1.2::DOUBLE AS k1, 0.75::DOUBLE AS b, 16::BIGINT AS m, true AS has_new_column, true AS deleted, false AS deleted_again, true AS missing_is_an_error")
def idx_lifecycle(spark, d):
    """Create with settings of one's own, add a column, delete, delete again, and load what isn't there."""
    path = _index(spark, d)
    made = X.settings(spark, path)
    X.evolve(spark, path, {"note": "string"}, "c")
    has = "note" in X.load_index(spark, path).columns
    created, first, second = X.exists(spark, path), X.delete_index(spark, path), X.delete_index(spark, path)
    try:
        X.load_index(spark, path)
        missing = False
    except FileNotFoundError:
        missing = True
    row = [(created, float(made["similarity"]["k1"]), float(made["similarity"]["b"]), made["vectors"]["m"], has, first, second, missing)]
    return spark.createDataFrame(row, "created boolean, k1 double, b double, m long, has_new_column boolean, deleted boolean, deleted_again boolean, missing_is_an_error boolean")


@query("idx_postings", "WITH c AS (" + _LATEST + "), t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM c) SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM t GROUP BY term")
def idx_postings(spark, d):
    path = staged_path(spark, "index")
    X.create_index(latest_rows(table(spark, d, "chunks").select("id", "text", "ingested_at"), ["id"], "ingested_at").drop("ingested_at"), path)
    return X.load_index(spark, path, "postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_WINDOWS = r"""
WITH t AS (SELECT doc_id::VARCHAR AS id, text, regexp_extract_all(text, '[^\s]+') AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT id, text, t, len(t) AS n, unnest(range(0, greatest(0, ceil((len(t) - 64) / 48.0))::INT + 1)) AS k FROM t WHERE len(t) > 0),
k AS (SELECT *, max(k) OVER (PARTITION BY id) AS most FROM w WHERE k = 0 OR n - k * 48 >= 8)
"""


def _documents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    none = F.lit(None).cast("array<struct<title:string,start:int,level:int>>")
    return docs.select("id", "text", ingest.sections(F.col("text"), none).alias("sections"), F.lit(None).cast("array<struct<page:int,start:int,end:int>>").alias("pages"))


@query("idx_documents", _WINDOWS + """SELECT id || '#' || lpad(k::VARCHAR, 4, '0') AS id, id AS doc_id, k::INT AS chunk_id, least(64, n - k * 48)::INT AS token_count, array_to_string(t[k * 48 + 1 : k * 48 + 64], ' ') AS words,
 CASE WHEN k > 0 THEN id || '#' || lpad((k - 1)::VARCHAR, 4, '0') END AS prev_chunk_id, CASE WHEN k < most THEN id || '#' || lpad((k + 1)::VARCHAR, 4, '0') END AS next_chunk_id, 32 AS dims FROM k""")
def idx_documents(spark, d):
    """Documents cut, enriched, embedded and added to an index; read from it again."""
    path = staged_path(spark, "index")
    ingest.index_documents(spark, path, _documents(spark, d), lambda: HashEmbedder(32), "a", size=64, overlap=16, least=8)
    words = F.array_join(T.tokens(F.col("text")), " ")
    return X.current(spark, path).select("id", "doc_id", "chunk_id", "token_count", words.alias("words"), "prev_chunk_id", "next_chunk_id", F.size("vector").alias("dims"))


@query("idx_sentences", _TEI.replace("id AS path, printf(", "id || '#' || printf(").replace("END, n) AS sentence_id", "END, n) AS id"))
def idx_sentences(spark, d):
    path = staged_path(spark, "index")
    s = tei_rows(_tei(spark, d)).select(F.concat_ws("#", "path", "sentence_id").alias("id"), "text", "section", "order")
    ingest.index_sentences(spark, path, s, lambda: HashEmbedder(16))
    return X.load_index(spark, path).where("size(vector) = 16").select("id", "text", "section", "order")


_HEADING = r"""s <> '' AND length(s) <= 120 AND s NOT LIKE '%.' AND (regexp_matches(s, '^([0-9]+(\.[0-9]+)*)\s+[^\d]+') OR length(regexp_replace(s, '[^\p{Lu}]', '', 'g'))::DOUBLE / greatest(1, length(regexp_replace(s, '[^\p{L}]', '', 'g'))) > 0.6
 OR (regexp_matches(s, '\p{L}') AND NOT regexp_matches(s, '(^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}')))"""


@query("chunk_sections", rf"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS n, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
o AS (SELECT doc_id, n, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s, (sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(raw) - 1)::INT AS place FROM l),
h AS (SELECT doc_id, place AS start, regexp_replace(regexp_replace(s, ':+$', ''), '^\s+|\s+$', '', 'g') AS title, CASE WHEN regexp_matches(s, '^([0-9]+(\.[0-9]+)*)\s') THEN length(s) - length(replace(s, '.', '')) + 1 ELSE 1 END::INT AS level FROM o WHERE {_HEADING})
SELECT doc_id, start, title, level FROM h UNION ALL SELECT doc_id, 0, 'Body', 1 FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM h)""")
def chunk_sections(spark, d):
    none = F.lit(None).cast("array<struct<title:string,start:int,level:int>>")
    s = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(ingest.sections(F.col("text"), none)).alias("s"))
    return s.select("doc_id", "s.start", "s.title", "s.level")


@query("chunk_enriched", rf"""
{_WINDOWS.rstrip()},
c AS (SELECT id, k, len(list_transform(regexp_extract_all(lower(array_to_string(t[k * 48 + 1 : k * 48 + 64], ' ')), '[a-z0-9][a-z0-9\-]+'), lambda x: x)) AS keys FROM k)
SELECT id || '#' || lpad(k::VARCHAR, 4, '0') AS id, keys::INT AS n_keys, true AS text_is_the_span, true AS section_is_the_last_before FROM c""")
def chunk_enriched(spark, d):
    """Each window's keywords, and whether its text is what its offsets name and its section the last that starts before it."""
    docs = stage(_documents(spark, d), "sectioned")  # its sections are read on both sides of the join
    c = ingest.enriched_chunks(docs, 64, 16, 8)
    j = c.join(docs.select(F.col("id").alias("doc_id"), F.col("text").alias("whole"), "sections"), "doc_id")
    last = F.element_at(F.filter("sections", lambda s: s["start"] <= F.col("char_start")), -1)
    first = F.get("sections", F.lit(0))["title"]
    span = F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    ok = F.col("section_title") == F.coalesce(F.when(F.size(F.filter("sections", lambda s: s["start"] <= F.col("char_start"))) > 0, last["title"]), first)
    return j.select("id", F.size("keyword_key").alias("n_keys"), (F.col("text") == span).alias("text_is_the_span"), ok.alias("section_is_the_last_before"))


@query("chunk_mined_anchors", r"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS n, unnest(x) AS raw FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS x FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, min(n) AS n, t FROM (SELECT doc_id, n, regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), ':+$', '') AS t FROM l WHERE regexp_matches(regexp_replace(raw, '^\s+', ''), '^\p{Lu}')) GROUP BY doc_id, t)
SELECT d.doc_id, coalesce(list(s.t ORDER BY s.n) FILTER (s.t IS NOT NULL), [])[1:3] AS titles FROM documents d LEFT JOIN s USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def chunk_mined_anchors(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.anchors_mined(F.col("text"), 3)["section_titles"].alias("titles"))


@query("idx_parents", rf"""
WITH s AS (SELECT doc_id AS id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL), e AS (SELECT id, unnest(range(len(s))) AS pos, unnest(s) AS x FROM s),
n AS (SELECT id, pos, x, ntile(3) OVER (PARTITION BY id ORDER BY pos) - 1 AS part FROM e) SELECT id AS parent, part::INT AS child, string_agg(x, ' ' ORDER BY pos) AS text, 16 AS dims FROM n GROUP BY id, part""")
def idx_parents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null")
    return ingest.parent_children(docs, 3, lambda: HashEmbedder(16)).select("parent", "child", "text", F.size("vector").alias("dims"))


@query("idx_questions", rf"""
WITH s AS (SELECT doc_id AS id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL), g AS (SELECT id, s, unnest(range(0, ceil(len(s) / 4.0)::INT)) AS chunk FROM s WHERE len(s) > 0),
t AS (SELECT id, chunk, array_to_string(s[chunk * 4 + 1 : chunk * 4 + 4], ' ') AS text FROM g),
a AS (SELECT *, regexp_extract(text, '^(?s:(.*?[.!?])\s)', 1) AS first FROM t), b AS (SELECT *, regexp_replace(regexp_extract(regexp_replace(regexp_replace(CASE WHEN first = '' THEN text ELSE first END, '(?s)^.*?Question:', ''), '^\s+', ''), '^([^\r\n]*)', 1), '^\s+|\s+$', '', 'g') AS line FROM a)
SELECT id, chunk::INT AS chunk, CASE WHEN line = '' OR upper(line) LIKE 'INVALID%' THEN 'INVALID' WHEN line LIKE '%?' THEN line ELSE regexp_replace(line, '[. ]+$', '') || '?' END AS question, 16 AS dims FROM b""")
def idx_questions(spark, d):
    """Every four sentences with a question, by a stand-in that gives the first sentence back."""
    from papyra.models import EchoModel

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null")
    return ingest.question_index(docs, EchoModel, lambda: HashEmbedder(16)).select("id", "chunk", "question", F.size("vector").alias("dims"))


@query("prj_source_fields", "SELECT id, doc_id, section_title FROM chunks")
def prj_source_fields(spark, d):
    return R.source_fields(table(spark, d, "chunks"), ["id", "doc_id", "section_title", "not_stored"])
