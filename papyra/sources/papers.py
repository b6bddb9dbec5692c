"""Reading and writing paper metadata and full-text payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from papyra.functions.records import first_non_empty, in_categories
from papyra.functions.text import strip

PAPER = t.StructType([
    t.StructField("id", t.StringType()), t.StructField("title", t.StringType()), t.StructField("abstract", t.StringType()), t.StructField("authors", t.StringType()),
    t.StructField("authors_parsed", t.ArrayType(t.ArrayType(t.StringType()))), t.StructField("categories", t.StringType()), t.StructField("update_date", t.StringType()),
])


def read_papers(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON lines with an explicit schema. Malformed and blank lines are dropped; ``strict`` raises on them, and on no papers.

    A category list given as a JSON array is read as its text, which ``papyra.operators.packed`` splits."""
    df = spark.read.schema(PAPER).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    if strict:
        if not df.limit(1).count():
            raise ValueError(f"no papers in {path}")
        return df.withColumn("abstract", strip(F.col("abstract")))
    return df


def copy_filtered(papers: DataFrame, target: str, wanted: list[str]) -> tuple[int, int]:
    """Write the papers of the wanted categories as JSON lines; how many were read and how many kept, counted on the way."""
    seen = Observation("papers")
    keep = in_categories(F.col("categories"), wanted)
    papers.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("kept")).where(keep).write.mode("overwrite").json(target)
    return int(seen.get["total"]), int(seen.get["kept"])


def read_payloads(spark: SparkSession, path: str, *text_fields: str) -> DataFrame:
    """Whole-file JSON payloads, with ``text``: the first of the fields that isn't blank (processed_text, then full_text, then
    summary, unless others are named)."""
    fields = text_fields or ("processed_text", "full_text", "summary")
    df = spark.read.option("multiLine", True).json(path)
    have = [F.col(f) for f in fields if f in df.columns]
    return df.withColumn("text", first_non_empty(*have) if have else F.lit(None).cast("string"))


def payload_text(raw: Column, *text_fields: str) -> Column:
    """The text of a payload given as JSON: the first of the fields that isn't blank; null for malformed JSON."""
    fields = text_fields or ("processed_text", "full_text", "summary")
    j = F.from_json(raw, ", ".join(f"`{f}` string" for f in fields))
    return first_non_empty(*[j[f] for f in fields])


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Add each missing column with its default, and fill nulls of the others with it."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def with_metadata(papers: DataFrame, metadata: DataFrame, fill: list[str], keys: tuple[str, ...] = ("filepath", "arxiv_id")) -> DataFrame:
    """Left join by the first key both sides have; blank values are filled from the metadata. One metadata row per key counts."""
    key = next((k for k in keys if k in papers.columns and k in metadata.columns), None)
    if key is None:
        raise ValueError(f"no common key among {keys}")
    side = metadata.select(key, *[F.col(c).alias(f"{c}__meta") for c in fill]).where(F.col(key).isNotNull()).dropDuplicates([key])
    out = papers.join(side, key, "left")
    for c in fill:
        have: Column = F.nullif(strip(F.col(c)), F.lit("")) if c in papers.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.coalesce(have, F.col(f"{c}__meta"), F.lit(""))).drop(f"{c}__meta")
    return out


def write_report(df: DataFrame, path: str, as_text: str | None = None) -> None:
    """JSON lines, or one text column as lines."""
    if as_text:
        df.select(as_text).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)
