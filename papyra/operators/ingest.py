"""Full texts into indexed chunks: sections, enriched windows, vectors, parents with children, generated questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.text import HEADING_NUMBER, heading, model_names, normalised_terms, question_line, strip, window_spans
from papyra.models import Embedder, TextModel, embed, generated
from papyra.operators.chunking import balanced_parts, near_heading, page_at, sentence_groups
from papyra.sources.index import create_index, upsert
from papyra.sources.tei import read_tei
from papyra.storage import stage

SECTION = "array<struct<start:int,title:string,level:int>>"
#: header score of a chunk that starts near no heading (fixed value)
HEADER_FLOOR = 1e-6


def sections(text: Column, given: Column, fallback: str = "Body") -> Column:
    """array<struct<start, title, level>> by start: the given ones (structs of title, start, level) that have a title; else the
    lines that read as headings, numbered ones one level deeper for each point; else one section ``fallback``."""
    titled = F.filter(given, lambda s: F.coalesce(strip(s["title"]), F.lit("")) != "")
    own = F.transform(titled, lambda s: F.struct(F.coalesce(s["start"], F.lit(0)).cast("int").alias("start"), strip(s["title"]).alias("title"), F.coalesce(F.nullif(s["level"], F.lit(0)), F.lit(1)).cast("int").alias("level")))
    number = lambda x: F.regexp_extract(strip(x), HEADING_NUMBER, 1)
    points = lambda x: F.length(strip(x)) - F.length(F.replace(strip(x), F.lit("."), F.lit("")))
    mined = lambda x: F.struct(x["at"].alias("start"), strip(F.regexp_replace(strip(x["line"]), ":+$", "")).alias("title"), F.when(number(x["line"]) != "", points(x["line"]) + 1).otherwise(1).cast("int").alias("level"))
    one = F.array(F.struct(F.lit(0).alias("start"), F.lit(fallback).alias("title"), F.lit(1).alias("level"))).cast(SECTION)
    named = lambda out: F.when(F.size(out) > 0, F.transform(out, mined).cast(SECTION)).otherwise(one)
    lines = F.split(text, "\n")
    # each line with the length of all lines before it
    walked = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,line:string>>").alias("out")),
        lambda s, x: F.struct((s["at"] + F.length(x) + 1).alias("at"), F.when(heading(x), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), x.alias("line"))))).otherwise(s["out"]).alias("out")),
        lambda s: named(s["out"]),
    )
    # lines come in order; the walk stands here once, as Spark evaluates such an expression wherever it stands
    given_first = F.array_sort(own.cast(SECTION), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return F.when(F.size(own) > 0, given_first).otherwise(walked)


def enriched_chunks(docs: DataFrame, size: int = 512, overlap: int = 128, least: int = 40, reach: int = 400) -> DataFrame:
    """Token windows of ``docs(id string, text, sections, pages)`` with everything a chunk carries.

    ``sections``: as ``sections`` gives them; ``pages``: array<struct<page, start, end>> or null. Out: id (``doc#0000``), doc_id,
    chunk_id, text, char_start, char_end, token_count, section_title, section_level, headings (titles so far), header_score (1
    within ``reach`` characters after a heading), page_num, model_names, keyword_key, prev_chunk_id, next_chunk_id.
    Windows follow in closed form from the number of tokens; links do too, so that no document is ordered as one group.
    Null ids and texts without tokens give no rows."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to less than size")
    d = docs.where("id is not null and text is not null").select("id", "text", "sections", "pages", window_spans(F.col("text"), size, overlap, least).alias("t"))
    w = d.select("id", "text", "sections", "pages", (F.size("t") - 1).alias("most"), F.posexplode("t").alias("chunk_id", "w"))
    w = w.select("id", "text", "sections", "pages", "most", "chunk_id", F.col("w.start").alias("char_start"), F.col("w.end").alias("char_end"), F.col("w.tokens").alias("token_count"))
    at = F.col("char_start")
    before = F.filter("sections", lambda s: s["start"] <= at)
    here = F.when(F.size(before) > 0, F.element_at(before, -1)).otherwise(F.get("sections", F.lit(0)))
    body = F.substring("text", at + 1, F.col("char_end") - at)
    name = lambda c: F.concat("id", F.lit("#"), F.lpad(c.cast("string"), 4, "0"))
    return w.select(
        name(F.col("chunk_id")).alias("id"), F.col("id").alias("doc_id"), "chunk_id", body.alias("text"), "char_start", "char_end", "token_count",
        here["title"].alias("section_title"), here["level"].alias("section_level"), F.when(F.size(before) > 0, F.transform(before, lambda s: s["title"])).otherwise(F.array(here["title"])).alias("headings"),
        F.when(near_heading(at, F.col("sections"), reach), 1.0).otherwise(HEADER_FLOOR).alias("header_score"),
        page_at(at, F.col("pages"))["page"].alias("page_num"), model_names(body).alias("model_names"), normalised_terms(body).alias("keyword_key"),
        F.when(F.col("chunk_id") > 0, name(F.col("chunk_id") - 1)).alias("prev_chunk_id"), F.when(F.col("chunk_id") < F.col("most"), name(F.col("chunk_id") + 1)).alias("next_chunk_id"),
    )


def index_documents(spark: SparkSession, path: str, docs: DataFrame, factory: Callable[[], Embedder], generation: str, **windows: int) -> None:
    """Chunk, embed and add documents to an index; a vector for each text, or an error."""
    # written once, with the vectors: the checks and the index read them again
    upsert(spark, path, stage(embed(enriched_chunks(docs, **windows), "id", "text", factory, keep=True), "embedded-chunks"), generation)


def index_sentences(spark: SparkSession, path: str, sentences: DataFrame, factory: Callable[[], Embedder], recreate: bool = False) -> None:
    """An index of single sentences ``(id, text, section, order)`` with their vectors."""
    vectors = embed(sentences.select("id", "text"), "id", "text", factory)
    create_index(sentences.join(vectors, "id"), path, recreate)


def index_tei(spark: SparkSession, path: str, files: str, factory: Callable[[], Embedder], recreate: bool = False) -> None:
    """The sentences of TEI files as an index; ids are file and sentence."""
    s = read_tei(spark, files).select(F.concat_ws("#", F.element_at(F.split("path", "/"), -1), "sentence_id").alias("id"), "text", "section", "order")
    index_sentences(spark, path, s, factory, recreate)


def parent_children(parents: DataFrame, children: int, factory: Callable[[], Embedder]) -> DataFrame:
    """``(parent, child, text, vector)``: each parent ``(id, text)`` cut into so many runs of sentences, each with its vector.

    Parents without sentences are skipped; an error if none is left."""
    parts = balanced_parts(parents, children).select(F.col("id").alias("parent"), F.col("part").alias("child"), "text", F.concat_ws("/", "id", "part").alias("key"))
    if not parts.limit(1).count():
        raise ValueError("no parent has any text")
    return parts.join(embed(parts.select("key", "text"), "key", "text", factory), "key").drop("key")


def question_index(docs: DataFrame, model: Callable[[], TextModel], factory: Callable[[], Embedder], sentences: int = 4) -> DataFrame:
    """``(id, chunk, text, question, vector)``: every so many sentences of a document with a generated question, and the vector
    of the question. Chunks without a usable question keep ``INVALID``, and its vector."""
    c = sentence_groups(docs, sentences).select("id", "chunk", "text", F.concat_ws("/", "id", "chunk").alias("key"))
    asked = generated(c.select("key", "text"), "key", "text", model).select("key", question_line(F.col("generated")).alias("question"))
    rows = c.join(asked, "key")
    return rows.join(embed(rows.select("key", "question"), "key", "question", factory), "key").drop("key")
