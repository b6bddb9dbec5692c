"""Search indexes as Parquet tables: chunks with vectors, and postings ordered by term."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from papyra.operators.latest import latest_rows
from papyra.operators.lexical import postings


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete_index(spark: SparkSession, path: str) -> bool:
    """Remove the index if there is one; whether there was."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p) and fs.delete(p, True))


#: settings of a new index: analyzer, similarity and graph parameters (fixed values; retrieval takes them as arguments)
SETTINGS = {"analyzer": "english", "similarity": {"k1": 1.4, "b": 0.75}, "vectors": {"dims": 768, "metric": "cosine", "m": 16, "ef_construction": 128}}


def merged_settings(base: dict, extra: dict | None) -> dict:
    """``extra`` over ``base``, section by section."""
    out = dict(base)
    for k, v in (extra or {}).items():
        out[k] = merged_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def settings(spark: SparkSession, path: str) -> dict:
    """The settings an index was made with."""
    return json.loads(load_index(spark, path, "settings").first()["settings"])


def evolve(spark: SparkSession, path: str, columns: dict[str, str], generation: str) -> None:
    """Make new columns part of an index: an empty generation that has them. A column known with another type is an error."""
    have = load_index(spark, path)
    known = dict(have.dtypes)
    wrong = {c: k for c, k in columns.items() if known.get(c, k) != k}
    if wrong:
        raise ValueError(f"columns of another type in the index: {json.dumps(wrong)}")
    fields = {"id": known["id"], **columns, "generation": "string"}
    spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in fields.items())).write.mode("append").parquet(f"{path}/chunks")


def create_index(chunks: DataFrame, path: str, recreate: bool = False, dims: int | None = None, extra_settings: dict | None = None) -> None:
    """Write ``chunks`` (id, text and any other columns; vector if there are vectors) with its postings.

    Ids must not be null, and vectors, where given, must have ``dims`` numbers. Postings are range-partitioned and sorted by
    term, so that looking up terms reads few row groups. Without ``recreate`` an existing index is an error."""
    bad = F.col("id").isNull()
    if dims is not None and "vector" in chunks.columns:
        bad = bad | (F.col("vector").isNotNull() & (F.size("vector") != dims))
    if chunks.where(bad).limit(1).count():
        raise ValueError("a chunk has no id, or a vector of another length")
    mode = "overwrite" if recreate else "errorifexists"
    chunks.write.mode(mode).parquet(f"{path}/chunks")
    made = json.dumps(merged_settings(SETTINGS, extra_settings))
    chunks.sparkSession.range(1).select(F.lit(made).alias("settings")).write.mode(mode).parquet(f"{path}/settings")
    postings(chunks.select("id", "text")).repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str, table: str = "chunks") -> DataFrame:
    try:
        return spark.read.option("mergeSchema", True).parquet(f"{path}/{table}")
    except AnalysisException as e:
        raise FileNotFoundError(f"no index at {path}; create it first") from e


def upsert(spark: SparkSession, path: str, chunks: DataFrame, generation: str) -> None:
    """Add chunks as a new generation; new columns are allowed. ``current`` shows the newest row of each id.

    Appending keeps what is stored untouched, so a lost task or a failed write never harms the index."""
    if chunks.where("id is null").limit(1).count():
        raise ValueError("a chunk has no id")
    chunks.withColumn("generation", F.lit(generation)).write.mode("append").parquet(f"{path}/chunks")


def current(spark: SparkSession, path: str) -> DataFrame:
    df = load_index(spark, path)
    return latest_rows(df, ["id"], "generation") if "generation" in df.columns else df


def fetch(spark: SparkSession, path: str, *ids: str) -> DataFrame:
    """Rows of the given ids; the filter reaches the Parquet scan."""
    return current(spark, path).where(F.col("id").isin(list(ids)))


def fetch_many(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``wanted(id)`` with the stored columns, null where an id isn't stored."""
    return wanted.select("id").join(current(spark, path), "id", "left")


def require_columns(df: DataFrame, allowed: dict[str, str]) -> DataFrame:
    """The frame, if every column is allowed and of its type; otherwise an error that names the others."""
    wrong = {c: k for c, k in df.dtypes if allowed.get(c) != k}
    if wrong:
        raise ValueError(f"columns not in the index's schema: {json.dumps(wrong)}")
    return df
