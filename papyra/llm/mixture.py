"""Mix sources to target shares of tokens: complete epochs, then weighted sampling without replacement for the rest.

The fraction of an epoch is drawn by Efraimidis and Spirakis' keys: -ln(u) / w, smallest first, for u hashed from the
document's id. Prefix sums of tokens in key order come from a table of token sums per key bucket, so that no source is
ever sorted as one group.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.storage import small_side, stage

#: the split pattern that belongs to the byte-level vocabularies (fixed value)
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _counter(vocabulary, pattern: str):
    """Token counts by a vocabulary that was broadcast: lines of a base64 token and its rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.value.splitlines() if line.strip())}
        enc = tiktoken.Encoding("papyra", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return run


class Mixture:
    """Documents with how often each is taken, and what shares come out.

    Tokens are those of the public ``tokenizer``, a file of ranks that only the driver reads, and its split ``pattern``.
    ``documents``: doc_id, source, text; ``targets``: source, target_share, max_repeats (a source named twice counts with its
    largest values); ``weights``: doc_id, weight (several rows of a document: their mean; none, null or not above 0: 1).
    The mixture's size is ``total_tokens``, or the largest at which no source that has documents needs more than
    ``max_repeats`` passes. A target source without documents gets nothing, and its share falls to the others in proportion,
    as do sources with a null or non-positive share or cap. Documents with a null id, text or source, or of a source
    without a target, are not taken. Texts of no tokens are taken as often as their rank in key order says. A doc_id given
    twice counts once. Empty tables give no rows.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, weights: DataFrame, tokenizer: str, pattern: str = BYTE_LEVEL_PATTERN, total_tokens: int | None = None, seed: int = 11, bucket_rows: int = 5000):
        t = targets.select("source", "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
        t = stage(t, "mix-targets")
        d = documents.select("doc_id", "source", "text").where("doc_id is not null and text is not null and source is not null")
        named = t.select("source")
        d = d.join(small_side(named), "source", "left_semi").select("doc_id", "source", "text")
        vocabulary = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
        counted = d.mapInArrow(_counter(vocabulary, pattern), "doc_id long, source string, tokens long")
        w = weights.where("weight > 0 and doc_id is not null").groupBy("doc_id").agg(F.avg("weight").alias("weight"))
        u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
        one = counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.*")
        self.docs = stage(one.join(w, "doc_id", "left").withColumn("key", -F.log(u) / F.coalesce("weight", F.lit(1.0))), "mix-docs")
        have = self.docs.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("docs"))
        s = t.join(have, "source", "left").withColumn("usable", (F.col("available") > 0) & (F.col("share") > 0) & (F.col("cap") > 0))
        everything = Window.partitionBy()  # one row per target source
        part = F.col("share") / F.sum(F.when(F.col("usable"), F.col("share"))).over(everything)
        s = s.withColumn("part", F.when(F.col("usable"), part))
        most = F.min(F.col("cap") * F.col("available") / F.col("part")).over(everything)
        size = F.lit(float(total_tokens)) if total_tokens is not None else most
        s = s.withColumn("budget", F.least(F.col("part") * size, F.col("cap") * F.col("available")))
        s = s.withColumn("epochs", F.floor(F.col("budget") / F.col("available") + 1e-12)).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("available")))
        buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket_rows)).cast("int")
        self.sources = stage(s.withColumn("buckets", buckets), "mix-sources")

    def documents(self) -> DataFrame:
        """``(doc_id, source, tokens, repeats)`` of the documents taken at least once."""
        s = self.sources.where("usable").select("source", "epochs", "rest", "buckets", "cap")
        s = small_side(s)
        d = self.docs.join(s, "source")
        # a key's bucket: its place in the distribution of keys of weight 1, in as many steps as the source has buckets
        bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1).cast("int")
        d = d.withColumn("bucket", bucket)
        sums = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
        ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offset = sums.select("source", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
        inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("here", F.sum("tokens").over(inside)).join(offset, ["source", "bucket"])
        extra = (F.col("ahead") + F.col("here") <= F.col("rest")) & (F.col("epochs") < F.col("cap"))
        d = d.withColumn("repeats", (F.col("epochs") + extra.cast("long")).cast("int"))
        return d.where("repeats > 0").select("doc_id", "source", "tokens", "repeats")

    def shares(self) -> DataFrame:
        """One row per target source: its target, what it has, what was taken, and its actual share of all tokens taken."""
        taken = self.documents().groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.count("*").alias("docs_used"), F.max("repeats").alias("most_repeats"))
        out = self.sources.join(taken, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
        total = F.sum("mixed_tokens").over(Window.partitionBy())
        share = F.when(total > 0, F.col("mixed_tokens") / total).otherwise(F.lit(0.0))
        return out.select("source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), F.coalesce("available", F.lit(0)).alias("available_tokens"), "mixed_tokens", F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), share.alias("actual_share"))
