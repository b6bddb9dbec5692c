"""Whole searches as one lazy plan: chunk search by several keyword queries and vectors, and paper search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.records import in_field, year, year_between
from papyra.functions.text import section_bias, strip_stop_words, tokens
from papyra.operators import fusion as U
from papyra.operators import lexical as L
from papyra.operators.vector import vector_topk
from papyra.storage import small_side


@dataclass(frozen=True)
class SearchConfig:
    """Depths and constants of a chunk search (fixed values: 40 lexical, 80 semantic, 8 results, RRF constant 60, MMR over 50)."""

    lexical: int = 40
    semantic: int = 80
    results: int = 8
    constant: int = 60
    diversify: bool = False
    mmr_weight: float = 0.3
    mmr_most: int = 50
    bias: bool = True
    every_term: bool = False


def chunk_search(chunks: DataFrame, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``(qid, id, fused, rank)`` of ``chunks(id long, text, section_title, headings, vector)`` for ``queries(qid, number, text,
    vector)``: each numbered query text is a lexical list of its own, the vector (equal for all of a qid) one more list."""
    terms = L.query_terms(queries.select(F.struct("qid", "number").alias("qid"), "text"))
    index = L.text_index(chunks.select("id", "text"), terms)
    found = L.top_per_query(index.every(terms), config.lexical) if config.every_term else index.top(terms, config.lexical)
    lexical = found.select("qid.qid", "id", F.concat(F.lit("lexical "), F.col("qid.number").cast("string")).alias("list"), "rank")
    asked = queries.where("vector is not null").groupBy("qid").agg(F.first("vector").alias("v"))
    semantic = vector_topk(chunks.select("id", F.col("vector").alias("v")), asked, config.semantic, keep_self=True).select("qid", "id", F.lit("semantic").alias("list"), "rank")
    fused = U.rrf(lexical.unionByName(semantic), config.constant)
    if config.bias:
        fused = fused.join(chunks.select("id", section_bias(F.col("section_title"), F.array_join("headings", " ")).alias("bias")), "id").withColumn("fused", F.round(F.col("fused") * F.col("bias"), 9)).drop("bias")
    if config.diversify:
        # every candidate: the lists, config.lexical or config.semantic long each, bound them
        top = fused.join(chunks.select("id", F.array_distinct(tokens(F.lower("text"))).alias("tokens")), "id")
        return U.diversified(top, "long", config.mmr_weight, config.mmr_most).where(F.col("place") <= config.results).withColumnRenamed("place", "rank")
    return L.top_per_query(fused, config.results, F.desc("fused"), "id")


def lexical_quotes(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """``(qid, rank, quote)``: the texts of the k best of ``chunks(id, text)`` that hold every term left of each question
    ``(qid, text)`` without its function words."""
    terms = L.query_terms(questions.select("qid", strip_stop_words(F.col("text")).alias("text")))
    best = L.top_per_query(L.text_index(chunks.select("id", "text"), terms).every(terms), k)
    return best.join(chunks.select("id", "text"), "id").select("qid", "rank", F.col("text").alias("quote"))


def semantic_quotes(vectors: DataFrame, questions: DataFrame, k: int, texts: DataFrame) -> DataFrame:
    """``(qid, rank, quote)``: the ``texts(id, text)`` of the k of ``vectors(id long, vector)`` nearest to each question
    ``(qid, v)``; a vector without a text gives no quote."""
    near = vector_topk(vectors.select("id", F.col("vector").alias("v")), questions, k, keep_self=True)
    return texts.select("id", "text").join(small_side(near.select("qid", "id", "rank")), "id").select("qid", "rank", F.col("text").alias("quote"))


def knn(vectors: DataFrame, questions: DataFrame, k: int, candidates: int | None = None, filters: Column | None = None) -> DataFrame:
    """``(qid, id, score, rank)``: the k best of ``candidates`` (by default max(2 k, 100)) nearest vectors, among the rows of the
    filter. The candidates are exact, so that their number changes nothing but what is fetched."""
    rows = vectors if filters is None else vectors.where(filters)
    return vector_topk(rows, questions, max(k, candidates or max(2 * k, 100)), keep_self=True).where(F.col("rank") <= k)


def with_provenance(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with a ``provenance`` struct: document, chunk, section, page and character span."""
    c = chunks.select("id", F.struct("doc_id", "chunk_id", "section_title", "page_num", F.struct(F.col("char_start").alias("start"), F.col("char_end").alias("end")).alias("char_span")).alias("provenance"))
    return hits.join(c, "id")


def post_filter(hits: DataFrame, year_min: int | None = None, year_max: int | None = None, author: str | None = None, venue: str | None = None, field: str | None = None) -> DataFrame:
    """Paper hits within the bounds; columns update_date, authors, venue and categories (array) as far as the filters need."""
    out = hits
    if year_min is not None or year_max is not None:
        out = out.where(year_between(year(F.col("update_date")), year_min, year_max))
    for value, column in ((author, "authors"), (venue, "venue")):
        if value:
            out = out.where(F.lower(column).contains(value.lower()))
    return out.where(in_field(F.col("categories"), field)) if field else out


def paper_search(papers: DataFrame, queries: DataFrame, k: int = 15, fetch: int | None = None, strict_order: bool = False, **filters) -> DataFrame:
    """The k nearest papers of each query after filtering. ``papers``: id long, vector and the filters' columns; ``queries``: qid,
    v. With ``fetch`` so many rows a query are ranked before the filter, and ``strict_order`` cuts to k before filtering, so that
    fewer may remain; else the filter comes first."""
    if not strict_order and fetch is None:
        return vector_topk(post_filter(papers, **filters).select("id", F.col("vector").alias("v")), queries, k, keep_self=True).join(papers.drop("vector"), "id")
    depth = k if strict_order else max(fetch, k)
    near = vector_topk(papers.select("id", F.col("vector").alias("v")), queries, depth, keep_self=True)
    rows = post_filter(near.join(papers.drop("vector"), "id"), **filters)
    return L.top_per_query(rows.drop("rank"), k)


def parent_search(children: DataFrame, queries: DataFrame, k: int, per_parent: int = 3) -> DataFrame:
    """Parents ranked by their best child: ``children(id long, parent, vector)``; k * per_parent children are fetched first."""
    near = vector_topk(children.select("id", F.col("vector").alias("v")), queries, max(k * per_parent, k), "l2", keep_self=True).drop("rank")
    parents = near.join(children.select("id", "parent"), "id")
    best = parents.groupBy("qid", "parent").agg(F.max_by(F.struct("id", "score"), F.struct("score", (-F.col("id")).alias("o"))).alias("b")).select("qid", "parent", F.col("b.id").alias("child"), F.col("b.score").alias("score"))
    return L.top_per_query(best, k, F.desc("score"), "parent")


def question_search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, id, rank, text, question, distance)``: the k chunks of ``index(id long, text, question, vector)`` whose questions'
    vectors are nearest to each query ``(qid, v)``; the distance is the squared one, as it is."""
    near = vector_topk(index.select("id", F.col("vector").alias("v")), queries, k, "l2", keep_self=True)
    return index.select("id", "text", "question").join(small_side(near), "id").select("qid", "id", "rank", "text", "question", (F.lit(0.0) - F.col("score")).alias("distance"))


def rank_by_lists(answers: DataFrame, known: DataFrame) -> DataFrame:
    """``(qid, id, rank)`` of a model's ordering: its lines (qid, pos, line) matched to known texts (qid, id, text) after list
    numbers are stripped; unknown lines are dropped, repeats keep their first place."""
    from papyra.functions.text import list_prefix_stripped, strip

    a = answers.select("qid", "pos", list_prefix_stripped(F.col("line")).alias("t"))
    hit = a.join(small_side(known.select("qid", "id", strip(F.col("text")).alias("t"))), ["qid", "t"]).groupBy("qid", "id").agg(F.min("pos").alias("pos"))
    return hit.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "id")).alias("rank"))
