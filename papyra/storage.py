"""Intermediate results that outlive an executor: tables in the cluster's shared folder.

Lineage is cut by writing Parquet into the folder named by ``spark.checkpoint.dir``. Only a session on the local machine
may do without that setting (tests); on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: application -> folder of a local session; application -> paths of the tables written and not yet dropped
_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as a URI or path without a trailing slash."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = context.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
    app = context.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="papyra-")
    return _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, deleted with the session's other intermediate tables."""
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(drop_staged, spark)
    path = f"{shared_root(spark)}/papyra/{app}/{label}-{uuid.uuid4().hex}"
    _written[app].append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table; later actions reread it instead of recomputing ``df``."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._papyra_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more (others are left alone)."""
    for df in tables:
        path = getattr(df, "_papyra_path", None)
        if path:
            _delete(df.sparkSession, path)
            known = _written.get(df.sparkSession.sparkContext.applicationId, [])
            if path in known:
                known.remove(path)


def drop_staged(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables staged in this session, from the one numbered ``since`` on. Results that read them are void."""
    if spark.sparkContext._jsc is None:
        return
    app = spark.sparkContext.applicationId
    paths = _written.get(app, [])
    for path in paths[since:]:
        _delete(spark, path)
    del paths[since:]


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end: write results before that."""
    since = len(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        drop_staged(spark, since)


def _width(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if kind.startswith(("array", "struct", "map")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def small_side(df: DataFrame, max_rows: int = 50_000, max_bytes: int = 16 << 20) -> DataFrame:
    """Mark ``df`` for broadcast only if it has been measured: at most ``max_rows`` rows of at most ``max_bytes`` together.
    Otherwise it is left to shuffle.

    ``df`` should be staged or cheap, since it is read for this, up to one row beyond the limit."""
    few = df.limit(max_rows + 1)
    size = few.agg(F.count("*").alias("n"), F.sum(sum((_width(c, k) for c, k in df.dtypes), F.lit(8))).alias("b")).first()
    return F.broadcast(df) if size["n"] <= max_rows and (size["b"] or 0) <= max_bytes else df
