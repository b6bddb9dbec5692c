"""Queries over the test tables, one or more for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.abuse import AbuseScores
from papyra.llm.fusion import candidate_scores, fuse_ranks
from papyra.llm.leakage import leaked_spans
from papyra.llm.markup import clean_markup
from papyra.llm.mixture import Mixture
from papyra.llm.names import link_names, name_pairs
from papyra.llm.near_dup import NearDuplicates
from papyra.llm.splitting import split_oversized
from papyra.llm.vectors import SimilarVectors
from papyra.operators.latest import latest_rows
from papyra.operators.packed import packed_fields, split_packed


#: the public vocabulary that sizes are counted by, where the driver finds it
TOKENIZER = os.environ.get("PAPYRA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "chunks").select("id", F.col("specter2_vec").alias("vector"), F.col("ingested_at").alias("ver"))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return SimilarVectors(_chunk_vectors(spark, d), k=5).neighbours()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    n = SimilarVectors(_chunk_vectors(spark, d), k=5, min_similarity=0.9).neighbours()
    return n.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_t(spark, d, "chunks"), _t(spark, d, "chunking_configs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).select("chunk_id").distinct()


def record_texts(spark: SparkSession, d: str) -> DataFrame:
    """kind, id, text, ver of papers.abstract and chunks.text."""
    p = _t(spark, d, "papers").select(F.lit("abstract").alias("kind"), "id", F.col("abstract").alias("text"), F.col("ingested_at").alias("ver"))
    c = _t(spark, d, "chunks").select(F.lit("chunk").alias("kind"), "id", "text", F.col("ingested_at").alias("ver"))
    return p.unionByName(c)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(record_texts(spark, d), threshold=0.5, width=3, min_words=30).pairs()


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(record_texts(spark, d), threshold=0.5, width=3, min_words=30).groups()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    p, c = _t(spark, d, "papers"), _t(spark, d, "chunks")
    fields = c.select(F.lit("chunks").alias("tab"), F.col("id").alias("rec_id"), F.lit("text").alias("field"), "text", F.col("ingested_at").alias("ver"))
    for name in ("title", "abstract"):
        fields = fields.unionByName(p.select(F.lit("papers").alias("tab"), F.col("id").alias("rec_id"), F.lit(name).alias("field"), F.col(name).alias("text"), F.col("ingested_at").alias("ver")))
    return clean_markup(fields)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_clean(spark, d).select("tab", "rec_id", "field")


def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    packed = packed_fields(_t(spark, d, "papers"), "id", ["authors"], "ingested_at")
    return link_names(split_packed(packed).select(F.col("val").alias("name")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(p6_entities(spark, d))


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fuse_ranks(candidate_scores(_t(spark, d, "candidates")), "query_id", "chunk_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_ranking(spark, d).where("rank <= 5").select("query_id", "chunk_id")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaked_spans(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def _mixture(spark: SparkSession, d: str) -> Mixture:
    """Human quality marks (1 to 5), where there are any, as sampling weights; others weigh as the middle mark."""
    marks = _t(spark, d, "review_labels").where("quality is not null").select("doc_id", (F.col("quality") / 3.0).alias("weight"))
    return Mixture(_t(spark, d, "documents"), _t(spark, d, "mix_targets"), marks, TOKENIZER)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).documents()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def _abuse(spark: SparkSession, d: str) -> AbuseScores:
    return AbuseScores(_t(spark, d, "documents"), _t(spark, d, "review_labels"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).scores


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).scores.where("flagged").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).rates()


# ---- what must hold of results that SQL can't compute ----
def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each vector: how many neighbours it has, and whether they come best first, none of them itself."""
    n = p1_neighbours(spark, d)
    pairs = F.sort_array(F.collect_list(F.struct("rank", (-F.col("similarity")).alias("s"), "neighbour")))
    rows = n.groupBy("id").agg(pairs.alias("x"))
    falling = F.forall(F.sequence(F.lit(1), F.size("x")), lambda i: (F.element_at("x", i)["rank"] == i) & (F.element_at("x", i)["neighbour"] != F.col("id")) & ((i == 1) | (F.element_at("x", i)["s"] >= F.element_at("x", F.greatest(i - 1, F.lit(1)))["s"])))
    return rows.select("id", F.size("x").alias("neighbours"), falling.alias("best_first"))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized chunk: whether its pieces keep the limit, count right, overlap as told, and make up the whole text."""
    c = latest_rows(_t(spark, d, "chunks").select("id", "text", "config_id", "ingested_at"), ["id"], "ingested_at")
    k = _t(spark, d, "chunking_configs").select("config_id", F.col("tokens_per_chunk").alias("lim"), F.col("overlap_tokens").alias("ov"))
    p = p2_pieces(spark, d).select("chunk_id", "piece", "text", "token_count", "char_start", "char_end")
    j = p.join(c.select(F.col("id").alias("chunk_id"), F.col("text").alias("whole"), "config_id"), "chunk_id").join(F.broadcast(k), "config_id")  # six configurations
    words = F.regexp_extract_all("text", F.lit(r"((?U)\S+)"), 1)
    j = j.withColumn("words", words).withColumn("following", F.lead("words").over(Window.partitionBy("chunk_id").orderBy("piece")))
    limit = (F.size("words") <= F.col("lim")) & (F.size("words") == F.col("token_count"))
    span = F.col("text") == F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    overlap = F.col("following").isNull() | (F.slice("words", F.greatest(F.lit(1), F.size("words") - F.col("ov") + 1), F.col("ov")) == F.slice("following", F.lit(1), F.col("ov"))) | (F.col("ov") == 0)
    ends = F.min("char_start") == F.min(F.length(F.regexp_extract("whole", r"^(?U)(\s*)", 1)))
    all_ = F.max("char_end") == F.max(F.length(F.regexp_replace("whole", r"(?U)\s+$", "")))
    return j.groupBy("chunk_id").agg(F.bool_and(limit).alias("within_limit"), F.bool_and(span).alias("text_is_the_span"), F.bool_and(overlap).alias("overlap_as_told"), (ends & all_).alias("whole_text"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether each name stands once, and each entity is the smallest of its names."""
    e = p6_entities(spark, d)
    least = e.groupBy("entity").agg(F.min("name").alias("least"))
    once = e.agg((F.count("*") == F.count_distinct("name")).alias("each_name_once"))
    return once.join(F.broadcast(least.agg(F.bool_and(F.col("entity") == F.col("least")).alias("entity_is_its_smallest"))))  # one row each


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each target source: whether its share is met within a hundredth (as far as it has documents), and its cap kept."""
    s = p9_shares(spark, d)
    have = F.col("available_tokens") > 0
    told = F.col("target_share") / F.sum(F.when(have, F.col("target_share"))).over(Window.partitionBy())  # one row a source
    met = F.when(have, F.abs(F.col("actual_share") - told) <= 0.01).otherwise(F.col("mixed_tokens") == 0)
    return s.select("source", met.alias("share_met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"))


def p10_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each source: its documents, and whether its rate is that of flagged ones and its mean score a probability."""
    r = p10_rates(spark, d)
    return r.select("source", "documents", (F.abs(F.col("rate") * F.col("documents") - F.col("flagged")) < 1e-6).alias("rate_is_flagged_share"), F.col("mean_score").between(0, 1).alias("scores_are_probabilities"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_clean": p4_clean,
    "p6_entities": p6_entities,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_ranking": p7_ranking,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
    "p1_checks": p1_checks,
    "p2_checks": p2_checks,
    "p6_checks": p6_checks,
    "p9_checks": p9_checks,
    "p10_checks": p10_checks,
}
