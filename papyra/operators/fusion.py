"""Merging hit lists of lexical and vector search, and what follows: normalising, section bias, diversity, expansion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import alpha_ratio, completeness, informative, keyword_tokens, sentences
from papyra.operators.sequence import linked


def rrf(hits: DataFrame, constant: int = 60) -> DataFrame:
    """``(qid, id, fused)`` from ``(qid, id, list, rank)``: sum of 1 / (constant + rank), rounded to 9 digits."""
    return hits.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("fused"))


def merged(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Full outer merge of two hit lists ``(qid, id, score, rank)`` by query and item."""
    a = lexical.select("qid", "id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    b = semantic.select("qid", "id", F.col("score").alias("semantic_score"), F.col("rank").alias("semantic_rank"))
    return a.join(b, ["qid", "id"], "full")


def list_statistics(c: str) -> tuple[Column, Column]:
    """Mean and sample deviation of a query's scores: (0, 1) of none, deviation 1 of one value or of equal ones."""
    w = Window.partitionBy("qid")
    n = F.count(c).over(w)
    mean = F.coalesce(F.avg(c).over(w), F.lit(0.0))
    deviation = F.when(n < 2, F.lit(1.0)).otherwise(F.coalesce(F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)), F.lit(1.0)))
    return mean, deviation


def zscore_fused(hits: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Weighted z-scores of a merged list. A missing lexical score counts as 0 before it is normalised, a missing semantic
    one as the mean; statistics are over the scores present."""
    lm, ls = list_statistics("lexical_score")
    sm, ss = list_statistics("semantic_score")
    z_lex = (F.coalesce("lexical_score", F.lit(0.0)) - lm) / ls
    z_sem = F.coalesce((F.col("semantic_score") - sm) / ss, F.lit(0.0))
    return hits.withColumn("fused", F.round(alpha * z_lex + (1 - alpha) * z_sem, 6))


def max_normalised(hits: DataFrame, digits: int = 6) -> DataFrame:
    """Sum of both scores, each divided by the query's largest."""
    w = Window.partitionBy("qid")
    part = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(w), F.lit(0.0)), F.lit(0.0))
    return hits.withColumn("fused", F.round(part("lexical_score") + part("semantic_score"), digits))


def best_sentence(text: Column, wanted: Column) -> Column:
    """struct(score, sentence): the informative sentence that covers most wanted keywords; the first of all if none is."""
    s = sentences(text)
    share = lambda x: F.when(F.size(wanted) > 0, F.size(F.array_intersect(F.array_distinct(keyword_tokens(x)), wanted)) / F.size(wanted)).otherwise(F.lit(0.0))
    scored = F.transform(s, lambda x, i: F.struct(F.round(share(x) + 0.1 * alpha_ratio(x), 6).alias("score"), (-i).alias("place"), x.alias("sentence")))
    good = F.filter(scored, lambda x: informative(x["sentence"]))
    top = F.array_max(good)
    return F.struct(F.coalesce(top["score"], F.lit(-1.0)).alias("score"), F.coalesce(top["sentence"], F.get(s, F.lit(0)), F.lit("")).alias("sentence"))


def _greedy(weight: float, most: int):
    def run(t: pa.Table) -> pa.Table:
        fused = np.array(t.column("fused").to_pylist(), float)
        ids = t.column("id").to_pylist()
        sets = [set(x or ()) for x in t.column("tokens").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (-fused[i], ids[i]))
        worst = np.zeros(len(ids))
        taken: list[int] = []
        left = list(order)
        while left and len(taken) < most:
            value = [weight * fused[i] - (1 - weight) * worst[i] for i in left]
            i = left.pop(int(np.argmax(value)))
            taken.append(i)
            for j in left:
                if sets[i] and sets[j]:
                    worst[j] = max(worst[j], len(sets[i] & sets[j]) / len(sets[i] | sets[j]))
        return pa.table({"qid": pa.array([t.column("qid")[0].as_py()] * len(taken), pa.int64()), "id": t.column("id").take(pa.array(taken, pa.int64())), "fused": pa.array(fused[taken]), "place": pa.array(range(1, len(taken) + 1), pa.int32())})

    return run


def diversified(hits: DataFrame, id_type: str, weight: float = 0.3, most: int = 50) -> DataFrame:
    """Greedy maximal marginal relevance over ``(qid, id, fused, tokens)``: (qid, id, fused, place).

    Each pick depends on the ones before, so one query's candidates are one group: cut them to a retrieval depth first."""
    return hits.select("qid", "id", "fused", "tokens").groupBy("qid").applyInArrow(_greedy(weight, most), f"qid long, id {id_type}, fused double, place int")


def expanded(chunks: DataFrame, hops: int = 2) -> DataFrame:
    """Chunks ``(id, doc_id, chunk_id, text)`` with ``context``: following text joined until it reads as complete, at most so many
    steps; an incomplete one also takes the text before it. ``state`` is that of the context's end.

    Neighbours are found by id first; only chunks that still read as unfinished fetch a text."""
    near = linked(chunks, "doc_id", "chunk_id", "id")
    texts = chunks.select(F.col("id").alias("other"), F.col("text").alias("more"))
    after = near.select(F.col("id").alias("at"), F.col("after").alias("next"))
    rows = chunks.join(near, "id").withColumn("state", completeness(F.col("text"))).withColumn("context", F.col("text"))

    def fetched(df: DataFrame, key: str, wanted: Column) -> DataFrame:
        """Rows with ``more``: the text of the chunk named by ``key``, null unless wanted."""
        need = df.where(wanted & F.col(key).isNotNull())
        rest = df.where(~(wanted & F.col(key).isNotNull())).withColumn("more", F.lit(None).cast("string"))
        return need.join(texts, need[key] == texts["other"]).drop("other").unionByName(rest)

    rows = fetched(rows, "before", F.col("state") == "INCOMPLETE")
    rows = rows.withColumn("context", F.when(F.col("more").isNotNull(), F.concat_ws(" ", "more", "text")).otherwise(F.col("context"))).drop("more")
    for h in range(hops):
        rows = fetched(rows, "after", F.col("state") != "COMPLETE")
        grown = F.col("more").isNotNull()
        rows = rows.withColumn("context", F.when(grown, F.concat_ws(" ", "context", "more")).otherwise(F.col("context")))
        rows = rows.withColumn("state", F.when(grown, completeness(F.col("context"))).otherwise(F.col("state"))).drop("more")
        if h + 1 < hops:
            rows = rows.join(after, rows["after"] == after["at"], "left").drop("at", "after").withColumnRenamed("next", "after")
    return rows.drop("before", "after")
