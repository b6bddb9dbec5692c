"""Sources, sinks, index tables, streaming, models and the entry point."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra import models
from papyra.functions.text import window_spans
from papyra.models import HashEmbedder, VectorCache, device, once, timed
from papyra.operators import ingest
from papyra.operators.chunking import token_windows
from papyra.sources import index as I
from papyra.sources import papers as S
from papyra.sources.tei import read_tei, tei_sentences
from papyra.streaming import papers as stream


@pytest.fixture
def jsonl(tmp_path):
    p = tmp_path / "papers.jsonl"
    rows = [{"id": "1", "title": "t", "abstract": " a ", "categories": "cs.CL cs.LG"}, {"id": "2", "categories": "math.CO"}, {"id": "3", "categories": "cs.IR", "authors_parsed": [["B", "A", ""]]}]
    p.write_text("\n".join([json.dumps(rows[0]), "", "{broken", json.dumps(rows[1]), json.dumps(rows[2])]))
    return p


def test_papers(spark, jsonl, tmp_path):
    df = S.read_papers(spark, str(jsonl))
    assert sorted(r.id for r in df.collect()) == ["1", "2", "3"]
    assert S.copy_filtered(df, str(tmp_path / "out"), ["cs.CL", "cs.IR"]) == (3, 2)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception):
        S.read_papers(spark, str(jsonl), strict=True).collect()


def test_payload_fallback(spark, tmp_path):
    for i, x in enumerate([{"processed_text": " ", "full_text": "full"}, {"processed_text": "done", "full_text": "full"}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(x, indent=1))
    assert sorted(r.text for r in S.read_payloads(spark, str(tmp_path)).collect()) == ["done", "full"]


def test_metadata_join(spark):
    p = spark.createDataFrame([("a", ""), ("b", "kept"), ("c", None)], "arxiv_id string, venue string")
    m = spark.createDataFrame([("a", "filled"), ("b", "other"), ("a", "filled")], "arxiv_id string, venue string")
    assert {r.arxiv_id: r.venue for r in S.with_metadata(p, m, ["venue"]).collect()} == {"a": "filled", "b": "kept", "c": ""}
    assert S.with_defaults(p, {"year": "n.d.", "venue": "?"}).where("year = 'n.d.' and venue = '?'").count() == 1


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><p>Before any head.</p><head>One</head><p>First. Second!</p><p> </p><head> </head><p>Third.</p><head>Two</head><p>Fourth <hi>x</hi> y.</p></TEI>"""


def test_tei(spark, tmp_path):
    want = [("s0000-0001", "Before any head.", None, 0), ("s0001-0001", "First.", "One", 1), ("s0001-0002", "Second!", "One", 2), ("s0001-0003", "Third.", "One", 3), ("s0002-0001", "Fourth x y.", "Two", 4)]
    assert tei_sentences(TEI) == want
    (tmp_path / "a.xml").write_text(TEI)
    got = read_tei(spark, str(tmp_path)).orderBy("order").collect()
    assert [(r.sentence_id, r.text, r.section, r["order"]) for r in got] == want


def test_index(spark, tmp_path):
    path = str(tmp_path / "ix")
    c = spark.createDataFrame([("a", "alpha beta", [1.0, 0.0]), ("b", "beta", None)], "id string, text string, vector array<float>")
    with pytest.raises(FileNotFoundError):
        I.load_index(spark, path)
    I.create_index(c, path, dims=2)
    with pytest.raises(Exception):
        I.create_index(c, path)
    assert {(r.id, r.term, r.tf) for r in I.load_index(spark, path, "postings").collect()} == {("a", "alpha", 1), ("a", "beta", 1), ("b", "beta", 1)}
    I.upsert(spark, path, spark.createDataFrame([("b", "gamma", "new")], "id string, text string, note string"), "g1")
    now = {r.id: r.text for r in I.current(spark, path).collect()}
    assert now == {"a": "alpha beta", "b": "gamma"}
    assert I.fetch(spark, path, "b").first().note == "new"
    assert {r.id: r.text for r in I.fetch_many(spark, path, spark.createDataFrame([("a",), ("z",)], "id string")).collect()} == {"a": "alpha beta", "z": None}
    with pytest.raises(ValueError):
        I.create_index(c.withColumn("id", F.lit(None).cast("string")), path, recreate=True)
    with pytest.raises(ValueError):
        I.require_columns(c, {"id": "string"})
    assert I.delete_index(spark, path) and not I.delete_index(spark, path)


def test_streaming(spark, jsonl, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    jsonl.rename(src / "a.json")
    stream.run_available(stream.stream_papers(spark, str(src), ["cs.CL"]), str(tmp_path / "o"), str(tmp_path / "c"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["1"]


def test_windowed_counts(spark, tmp_path):
    e = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' k, 1.0D value union all select timestamp'2024-01-01 00:50:00', 'a', 2.0D union all select timestamp'2024-01-01 05:00:00', 'a', 4.0D")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    stream.run_available(stream.windowed_counts(s, "ts", "k"), str(tmp_path / "w"), str(tmp_path / "c"))
    assert [(r.n, r.total) for r in spark.read.parquet(str(tmp_path / "w")).collect()] == [(2, 3.0)]


def test_models(spark):
    df = spark.createDataFrame([(1, "alpha beta", "alpha"), (2, None, "x"), (3, "gamma", None)], "id long, t string, q string")
    v = {r.id: np.array(r.vector) for r in models.embed(df, "id", "t", models.HashEmbedder, batch=2).collect()}
    assert np.linalg.norm(v[1]) == pytest.approx(1, abs=1e-5) and np.linalg.norm(v[2]) == 0
    s = [r.id for r in models.cross_scored(df, "q", "t", models.OverlapScorer).orderBy(F.desc_nulls_last("cross_score"), "id").collect()]
    assert s[0] == 1
    assert {r.id: r.generated for r in models.generated(df, "id", "t", models.EchoModel).collect()} == {1: "alpha beta", 2: None, 3: "gamma"}


def test_entry_point():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and "r1_rrf_hybrid" in q and "p5_found" in q


def test_vector_cache_forgets_in_order():
    calls = []

    class Counting(HashEmbedder):
        def encode(self, texts):
            calls.extend(texts)
            return super().encode(texts)

    c = VectorCache(Counting(8), 2)
    for t in ("a", "b", "a", "c", "a"):
        c.vector(t)
    assert calls == ["a", "b", "c", "a"]


def test_models_are_built_once():
    assert once("x", list) is once("x", list)
    with timed("nothing"):
        pass
    assert device() in ("cpu", "cuda")


def test_enriched_chunks_and_odd_texts(spark):
    docs = spark.createDataFrame([("d", "1 Intro\nalpha beta gamma GraphNet\n2.1 Data:\ndelta epsilon", 1), ("e", "", 1), ("n", None, 1), (None, "x", 1)], "id string, text string, chunk_id int")
    none = F.lit(None).cast("array<struct<title:string,start:int,level:int>>")
    pages = F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("start"), F.lit(20).alias("end")), F.struct(F.lit(2).alias("page"), F.lit(20).alias("start"), F.lit(0).alias("end")))
    d = docs.select("id", "text", ingest.sections(F.col("text"), none).alias("sections"), pages.alias("pages"))
    got = {r.id: r for r in ingest.enriched_chunks(d, 4, 1, 1).collect()}
    assert sorted(got) == ["d#0000", "d#0001", "d#0002"]
    a, c = got["d#0000"], got["d#0002"]
    assert (a.section_title, a.section_level, a.page_num, a.header_score, a.prev_chunk_id, a.next_chunk_id) == ("1 Intro", 1, 1, 1.0, None, "d#0001")
    assert c.section_title == "2.1 Data" and c.section_level == 2 and list(c.headings) == ["1 Intro", "2.1 Data"] and c.page_num == 2 and c.next_chunk_id is None
    assert "GraphNet" in got["d#0001"].model_names or "GraphNet" in a.model_names


@pytest.mark.parametrize("size,overlap,least", [(4, 1, 1), (4, 1, 3), (64, 16, 8), (1, 0, 1)])
def test_window_spans_equal_the_tokens(spark, size, overlap, least):
    """Only a few numbers a window leave the worker, and they name what ``token_windows`` cuts."""
    docs = spark.createDataFrame([(n, "  ".join(f"w\u00e9{i}" for i in range(n)) + " ") for n in (0, 1, 3, 4, 5, 7, 8, 64, 70, 300)] + [(999, None)], "id long, text string")
    w = docs.select("id", "text", F.posexplode(window_spans(F.col("text"), size, overlap, least)).alias("chunk", "w"))
    got = {(r.id, r.chunk): (r.tokens, r.cut.split()) for r in w.select("id", "chunk", "w.tokens", F.substring("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("cut")).collect()}
    want = {(r.id, r.chunk): (r.token_end - r.token_start, r.text.split()) for r in token_windows(docs, size, overlap, least).collect()}
    assert got == want


def test_documents_are_cut_and_embedded_once(spark, tmp_path):
    """Every chunk is embedded once, and none is cut again to be checked or joined."""
    seen = spark.sparkContext.accumulator(0)

    class Counting(HashEmbedder):
        def encode(self, texts):
            seen.add(len(texts))
            return super().encode(texts)

    cuts = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        cuts.add(1)
        return x

    none = F.lit(None).cast("array<struct<title:string,start:int,level:int>>")
    docs = spark.createDataFrame([(f"d{i}", "One two three four. " * (i + 1)) for i in range(5)], "id string, text string").select("id", counted.asNondeterministic()("text").alias("text"))
    docs = docs.select("id", "text", ingest.sections(F.col("text"), none).alias("sections"), F.lit(None).cast("array<struct<page:int,start:int,end:int>>").alias("pages"))
    ingest.index_documents(spark, str(tmp_path / "ix"), docs, lambda: Counting(8), "a", size=4, overlap=0, least=1)
    rows = I.load_index(spark, str(tmp_path / "ix")).collect()
    assert len(rows) == 15 == seen.value and cuts.value == 5 and all(len(r.vector) == 8 for r in rows)


def test_tei_files_become_a_sentence_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("<TEI xmlns='x'><p>Before.</p><head>One</head><p>First one. Second one.</p></TEI>")
    ingest.index_tei(spark, str(tmp_path / "ix"), str(tmp_path / "in"), lambda: HashEmbedder(8))
    got = {r.id: (r.text, r.section, len(r.vector)) for r in I.load_index(spark, str(tmp_path / "ix")).collect()}
    assert got == {"a.xml#s0000-0001": ("Before.", None, 8), "a.xml#s0001-0001": ("First one.", "One", 8), "a.xml#s0001-0002": ("Second one.", "One", 8)}


def test_prompts_and_questions(spark):
    from papyra.functions.text import question_line

    df = spark.createDataFrame([("q", None, "a")], "q string, t string, a string")
    assert "Question: q\nTitle: \nAbstract: a" in df.select(models.relevance_prompt(F.col("q"), F.col("t"), F.col("a"))).first()[0]
    rows = spark.createDataFrame([("Here. Question: What is it.\nmore", "What is it?"), ("invalid", "INVALID"), ("  ", "INVALID"), (None, "INVALID"), ("Why?", "Why?")], "c string, want string")
    assert all(r.got == r.want for r in rows.select("want", question_line(F.col("c")).alias("got")).collect())


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from papyra import storage

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            applicationId = "x"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        storage.shared_root(Cluster)


def test_staged_tables_are_deleted(spark):
    from papyra.storage import small_side, stage, staging, unstage

    with staging(spark):
        t = stage(spark.range(5), "test")
        path = t._papyra_path
        assert I.exists(spark, path) and t.count() == 5
    assert not I.exists(spark, path)
    t = stage(spark.range(3), "test")
    unstage(t)
    assert not I.exists(spark, t._papyra_path)
    wide = spark.range(100).selectExpr("repeat('x', 1000) as s")
    hinted = lambda df: "BROADCAST" in df._jdf.queryExecution().logical().toString().upper()
    assert hinted(small_side(wide)) and not hinted(small_side(wide, max_bytes=50_000)) and not hinted(small_side(wide, max_rows=50))
