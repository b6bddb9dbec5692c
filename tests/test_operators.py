"""Core operators against plain restatements on small inputs."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyra.operators import chunking as C
from papyra.operators import fusion as U
from papyra.operators import lexical as L
from papyra.operators.blocking import block_pairs
from papyra.operators.components import connected_components
from papyra.operators.ivf import approximate_topk
from papyra.operators.latest import latest_rows
from papyra.operators.sequence import last_before, linked, numbered
from papyra.operators.query_spec import keyword_queries, parse_analysis
from papyra.operators.vector import vector_topk
from papyra.plans import pipeline as P


def loop_windows(n, size, overlap, least):
    out, start = [], 0
    while True:
        end = min(start + size, n)
        if not out or end - start >= least:
            out.append((start, end))
        if end == n:
            return out
        start += size - overlap


@pytest.mark.parametrize("size,overlap,least", [(50, 10, 40), (5, 2, 2), (4, 0, 1)])
def test_token_windows_equal_the_loop(spark, size, overlap, least):
    lengths = [1, 4, 5, 39, 40, 50, 51, 89, 90, 91, 130]
    df = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in lengths] + [(0, ""), (-1, None)], "id long, text string")
    got = {}
    for r in C.token_windows(df, size, overlap, least).collect():
        got.setdefault(r.id, []).append((r.token_start, r.token_end))
        assert len(r.text.split()) == r.token_end - r.token_start
    assert {k: sorted(v) for k, v in got.items()} == {n: loop_windows(n, size, overlap, least) for n in lengths}


def test_token_windows_reject_bad_sizes(spark):
    with pytest.raises(ValueError):
        C.token_windows(spark.createDataFrame([], "id long, text string"), 10, 10)


def test_balanced_parts(spark):
    df = spark.createDataFrame([(1, " ".join(f"S{i}." for i in range(7))), (2, "One. Two."), (3, "")], "id long, text string")
    got = sorted((r.id, r.part, r.sent_end - r.sent_start) for r in C.balanced_parts(df, 3).collect())
    assert got == [(1, 0, 3), (1, 1, 2), (1, 2, 2), (2, 0, 1), (2, 1, 1)]


def test_sentence_groups(spark):
    df = spark.createDataFrame([(1, "A. B. C. D.")], "id long, text string")
    assert [(r.chunk, r.text) for r in C.sentence_groups(df, 3).orderBy("chunk").collect()] == [(0, "A. B. C."), (1, "D.")]


def test_scored_parents_cover_all_sentences(spark):
    text = " ".join(f"Sentence number {i} has six words." for i in range(40))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = C.scored_parents(df, lambda texts: [0.5] * len(texts), least_words=30, most_sentences=10).orderBy("parent").collect()
    assert got[0].sent_start == 0 and got[-1].sent_end == 40
    assert all(a.sent_end == b.sent_start for a, b in zip(got, got[1:]))
    assert got[0].sent_end == 5  # equal probabilities: the latest split
    assert got[-1].eos_probability == 0.5


def test_scored_parents_where_the_model_fails(spark):
    df = spark.createDataFrame([(1, "A a. B b. C c. D d.")], "id long, text string")
    at = lambda fails, reuse: [(r.sent_start, r.sent_end, r.eos_probability if r.eos_probability == r.eos_probability else None) for r in C.scored_parents(df, lambda ts: [None if t.endswith(fails) else len(t) / 100 for t in ts], 6, 3, reuse=reuse).orderBy("parent").collect()]
    assert at("A a.", False)[0] == (0, 3, None) and at("A a.", True)[0] == (0, 1, None)
    assert at("C c.", False)[0] == (0, 2, None) and at("C c.", True)[0] == (0, 2, 0.09)


def test_section_and_page_lookup(spark):
    df = spark.sql("select array(named_struct('start', 0), named_struct('start', 100), named_struct('start', 500)) s, array(named_struct('start', 0, 'end', 100), named_struct('start', 100, 'end', cast(null as int))) p, explode(array(99, 100, 450, 901)) o")
    got = df.select("o", C.section_at(F.col("o"), F.col("s"))["start"].alias("a"), C.near_heading(F.col("o"), F.col("s")).alias("n"), C.page_at(F.col("o"), F.col("p"))["start"].alias("p")).collect()
    assert [tuple(r) for r in got] == [(99, 0, True, 0), (100, 100, True, 100), (450, 100, True, 100), (901, 500, False, 100)]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_vector_topk_equals_brute_force(spark, metric):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, v array<float>")
    got = {}
    for x in vector_topk(df, df.where("id < 3").select(F.col("id").alias("qid"), "v"), 5, metric).orderBy("qid", "rank").collect():
        got.setdefault(x.qid, []).append(x.id)
    w = v.astype(float)
    s = {"dot": w @ w.T, "cosine": (w @ w.T) / np.outer(np.linalg.norm(w, axis=1), np.linalg.norm(w, axis=1)), "l2": -((w[:, None] - w[None]) ** 2).sum(-1)}[metric]
    for q in range(3):
        assert got[q] == [i for i in np.lexsort((np.arange(60), -np.round(s[q], 6))) if i != q][:5]


def test_vector_topk_without_queries(spark):
    df = spark.createDataFrame([], "id long, v array<float>")
    assert vector_topk(df, df.select(F.col("id").alias("qid"), "v"), 3).count() == 0


def test_approximate_neighbours(spark):
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(30, 16)), 20, 0) + 0.3 * r.normal(size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (601, None)], "id long, v array<double>")
    q = df.where("id % 50 = 0").select(F.col("id").alias("qid"), "v")
    exact = {(a.qid, a.id) for a in vector_topk(df, q, 5, keep_self=True).collect()}
    got = {(a.qid, a.id) for a in approximate_topk(df, q, 5, 200).collect()}
    assert len(got) == len(exact) and len(got & exact) > 0.9 * len(exact)
    assert got == {(a.qid, a.id) for a in approximate_topk(df, q, 5, 200, block_rows=7).collect()}
    assert exact == {(a.qid, a.id) for a in approximate_topk(df, q, 5, 600).collect()}
    assert approximate_topk(df.where("false"), q, 5).count() == 0


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "the beta of betas, gamma"), (3, None), (4, ""), (None, "alpha")], "id long, text string")
    q = spark.createDataFrame([(0, "the alpha beta"), (1, "nothing"), (2, None), (3, "alpha gamma")], "qid long, text string")
    terms = L.query_terms(q)
    got = {(r.qid, r.id): r for r in L.bm25(docs, terms, 5).collect()}
    n, avg = 3, 5 / 3
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got[0, 1].score == pytest.approx(idf(1) * part(1, 2) + idf(2) * part(1, 2), abs=1e-6)
    assert got[0, 2].score == pytest.approx(idf(2) * part(2, 3), abs=1e-6)
    assert set(got) == {(0, 1), (0, 2), (3, 1), (3, 2)} and got[0, 1].rank == 1
    index = L.text_index(docs, terms)
    assert [(r.qid, r.id) for r in index.every(terms).collect()] == [(0, 1)]
    some = spark.createDataFrame([(0, 2), (0, 99), (3, 2)], "qid long, id long")
    assert {(r.qid, r.id): r.score for r in index.scored(terms, some).collect()} == {(0, 2): got[0, 2].score, (0, 99): 0.0, (3, 2): got[3, 2].score}
    empty = L.bm25(docs.where("false"), terms, 5)
    assert empty.count() == 0


def test_top_documents_against_brute_force(spark):
    """The documents left unscored never belong to the best, whatever the weights."""
    r = random.Random(2)
    docs = [(i, " ".join(r.choices([f"w{k}" for k in range(60)], weights=[1 / (k + 1) for k in range(60)], k=r.randint(3, 40)))) for i in range(400)]
    asked = [(q, " ".join(f"w{r.randrange(60)}" for _ in range(r.randint(1, 6)))) for q in range(30)]
    d, terms = spark.createDataFrame(docs, "id long, text string"), L.query_terms(spark.createDataFrame(asked, "qid long, text string"))
    got = sorted((x.qid, x.rank, x.id) for x in L.bm25(d, terms, 5).collect())
    index = L.text_index(d, terms)
    every = terms.select("qid").distinct().crossJoin(d.select("id"))
    want = L.top_per_query(index.scored(terms, every).where("score > 0"), 5)
    assert got == sorted((x.qid, x.rank, x.id) for x in want.collect())


def test_conjunctions_go_on_in_bounded_parts(spark, monkeypatch):
    """A batch of documents that all match all queries is never gathered whole; queries that ask for the same are answered once."""
    monkeypatch.setattr(L, "MOST_ROWS", 50)
    fs = pa.array([[1, 2]] * 40, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), fs, pa.array([[1.0, 0.5]] * 40)], ["id", "fs", "ws"])
    one = L._Asked([np.array([2])], [np.array([1]), np.array([2])], np.array([], np.int64))
    asked = SimpleNamespace(value=dict.fromkeys(range(20), one))
    parts = list(L._matcher(asked, None, 1.0)([batch]))
    assert sum(p.num_rows for p in parts) == 800 and max(p.num_rows for p in parts) < 50 + 40
    assert {x for p in parts for x in p.column(2).to_pylist()} == {0.5}
    few = list(L._matcher(asked, None, 1.0, 3)([batch]))
    assert {(x, y) for p in few for x, y in zip(p.column(0).to_pylist(), p.column(1).to_pylist())} == {(q, i) for q in range(20) for i in range(3)}


def test_conjunctions_with_the_score_of_other_terms(spark):
    docs = spark.createDataFrame([(i, "alpha beta" + " gamma" * (i % 3)) for i in range(9)], "id long, text string")
    must = spark.createDataFrame([(q, w) for q in (1, 2) for w in ("alpha", "beta")] + [(3, "alpha"), (4, "alpha"), (4, "never")], "qid long, term string")
    should = spark.createDataFrame([(1, "gamma"), (2, "gamma")], "qid long, term string")
    index = L.text_index(docs, must.unionByName(should))
    got = {(r.qid, r.id): r.score for r in index.among(docs.select("id").where("id < 8")).every(must, scored=should).collect()}
    want = {(r.qid, r.id): r.score for r in index.scored(should, docs.crossJoin(should.select("qid").distinct())).collect()}
    assert set(got) == {(q, i) for q in (1, 2, 3) for i in range(8)}
    assert all(v == want.get(k, 0.0) for k, v in got.items()) and got[1, 1] > 0 and got[3, 1] == 0
    firsts = L.top_per_query(index.every(must, first=2), 2, "id").collect()
    assert {(r.qid, r.id) for r in firsts} == {(q, i) for q in (1, 2, 3) for i in range(2)}


def test_phrases(spark):
    df = spark.sql("select array('we','treat','a','we','so','treat','it') t, 3.0D a, 1.0D b, cast(null as double) c")
    at = lambda slop, *p: df.select(L.phrase_frequency(F.col("t"), F.array(*map(F.lit, p)), slop)).first()[0]
    assert at(0, "we", "treat") == 1 and at(1, "we", "treat") == 1.5 and at(0, "it", "we") == 0 and at(0, "it") == 1
    assert at(2, "treat", "we", "it") == 0 and at(3, "treat", "we", "it") == pytest.approx(0.25)
    assert df.select(L.phrase_frequency(F.lit(None).cast("array<string>"), F.col("t"), 1)).first()[0] == 0


def test_phrase_is_looked_for_once(spark):
    """Queries that share a phrase share one search, and the frequencies are those of ``phrase_frequency``."""
    r = random.Random(5)
    docs = spark.createDataFrame([*[(i, r.choices("abcd", k=r.randint(0, 12))) for i in range(60)], (60, None)], "id long, terms array<string>")
    phrases = [["a", "b"], ["a", "a"], ["c"], ["b", "c", "a"], ["a", "never"], []]
    asked = spark.createDataFrame([(10 * n + i, p) for i, p in enumerate(phrases) for n in range(3)], "qid long, phrase array<string>")
    idf = L.inverse_frequencies(docs, asked.select(F.explode("phrase").alias("term")))
    _, hits = L.phrase_hits(docs, asked, idf, 2)
    assert hits.groupBy("pno", "id").count().where("count > 1").count() == 0 and hits.select("pno").distinct().count() == 4
    got = {(x.qid, x.id): x.phrase for x in L.phrase_scores(docs, asked, idf, 2).collect()}
    known = {x.term: x.idf for x in idf.collect()}
    every = asked.crossJoin(docs).select("qid", "id", "phrase", L.phrase_frequency(F.col("terms"), F.col("phrase"), 2).alias("f")).where("f > 0").collect()
    want = {(x.qid, x.id): sum(known[w] for w in set(x.phrase)) * x.f * 2.2 / (x.f + 1.2) for x in every}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_best_documents_by_fields_and_phrase(spark):
    """As if every document were scored by its fields and its phrase."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, r.choices(words, weights=[1 / (j + 1) for j in range(12)], k=r.randint(2, 25))) for i in range(300)], "id long, terms array<string>")
    asked = [(q, r.choices(words, k=4)) for q in range(20)] + [(20, ["w3"]), (21, ["w1", "w2"]), (22, ["w1", "w2"])]
    q = spark.createDataFrame(asked, "qid long, t array<string>")
    terms = q.select("qid", F.explode(F.array_distinct("t")).alias("term"))
    phrases = q.where("size(t) > 1").select("qid", F.slice("t", -2, 2).alias("phrase"))
    index = L.LexicalIndex.build(docs, terms, {"text": (F.col("terms"), 1.0)})
    idf = index.features.select("term", "idf")
    got = index.top_with_phrases(terms, *L.phrase_hits(docs, phrases, idf, 2), 5, 0.2, 0.1)
    every = index.scored(terms, q.select("qid").crossJoin(docs.select("id")), 0.2).where("matched > 0")
    whole = every.join(L.phrase_scores(docs, phrases, idf, 2), ["qid", "id"], "left")
    want = L.top_per_query(whole.select("qid", "id", F.round(L.best_field(0.1, F.col("score"), F.col("phrase")) + 1e-9, 6).alias("score")), 5)
    key = lambda df: sorted((x.qid, x.rank, x.id, x.score) for x in df.collect())
    assert key(got) == key(want) and whole.where("phrase > score").count() > 0


def test_fields_and_clauses(spark):
    df = spark.sql("select array('we','treat','it') t, 3.0D a, 1.0D b, cast(null as double) c")
    assert df.select(L.best_field(0.2, F.col("a"), F.col("b"), F.col("c"))).first()[0] == pytest.approx(3.2)
    assert df.select(L.least_matching(F.col("t"), F.array(F.lit("we"), F.lit("x"), F.lit("it")))).first()[0]


def test_bool_query(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 2.0), (3, 1.0, 2.0), (4, None, None)], "id long, m double, s double")
    ids = lambda x: {r.id: r.score for r in x.collect()}
    assert ids(L.bool_query(df, ["m"], ["s"])) == {1: 1.0, 3: 3.0}
    assert ids(L.bool_query(df, [], ["s"])) == {2: 2.0, 3: 2.0}
    assert ids(L.bool_query(df, ["m"], ["s"], F.col("id") > 1, 1)) == {3: 3.0}


def test_rescoring_analyses_chunks_once_and_looks_phrases_up(spark, monkeypatch):
    """The phrases' scores are kept by phrase and chunk, never for every query that shares a phrase."""
    from papyra.plans import retrieval_queries as R

    staged = []
    monkeypatch.setattr(R, "stage", lambda df, label, real=R.stage: staged.append((label, df.columns)) or real(df, label))
    df = R.lex_rescore(spark, "/root/testdata/sf0.001")
    assert [label for label, _ in staged] == ["chunk-fields", "phrase-hits"] and staged[1][1] == ["pno", "id", "phrase"]
    assert df.count() == df.select("qid", "id").distinct().count() > 0


def test_rescored_window(spark):
    df = spark.createDataFrame([(0, i, 10.0 - i, i, 1.0 if i == 3 else 0.0) for i in range(1, 6)], "qid long, id long, score double, rank int, p double")
    got = [r.id for r in L.rescored(df, 3, "p").orderBy("new_rank").collect()]
    assert got == [1, 3, 2, 4, 5]


def test_rrf_golden(spark):
    hits = spark.createDataFrame([(0, "c0", "lex", 1), (0, "c1", "lex", 2), (0, "c1", "sem", 1)], "qid long, id string, list string, rank int")
    got = {r.id: r.fused for r in U.rrf(hits).collect()}
    assert got == {"c0": pytest.approx(1 / 61, abs=1e-9), "c1": pytest.approx(1 / 62 + 1 / 61, abs=1e-9)}


def test_zscore_fusion_degenerate_lists(spark):
    hits = spark.createDataFrame([(0, 1, 2.0, None), (1, 2, None, 3.0), (2, 3, 1.0, 5.0), (2, 4, 3.0, 5.0)], "qid long, id long, lexical_score double, semantic_score double")
    got = {r.id: r.fused for r in U.zscore_fused(hits).collect()}
    assert got[1] == 0 and got[2] == 0
    assert got[3] == pytest.approx(-0.5 / math.sqrt(2), abs=1e-6) and got[4] == -got[3]


def test_mmr_prefers_different_texts(spark):
    hits = spark.createDataFrame([(0, 1, 0.05, ["a", "b"]), (0, 2, 0.049, ["a", "b"]), (0, 3, 0.01, ["c"])], "qid long, id long, fused double, tokens array<string>")
    assert [r.id for r in U.diversified(hits, "long").orderBy("place").collect()] == [1, 3, 2]


def test_expanded(spark):
    c = spark.createDataFrame([("a", "d", 0, "First part of it,"), ("b", "d", 1, "and the rest."), ("c", "d", 2, "Done."), ("x", "e", 0, "of one"), ("y", None, 0, "Alone.")], "id string, doc_id string, chunk_id int, text string")
    got = {r.id: (r.context, r.state) for r in U.expanded(c).collect()}
    assert got["a"][0] == "First part of it, and the rest." and got["c"] == ("Done.", "COMPLETE") and got["x"] == ("of one", "INCOMPLETE") and got["y"] == ("Alone.", "COMPLETE")


def test_order_within_groups_of_any_size(spark):
    r = random.Random(5)
    rows = [(i, r.choice("ab"), r.choice([None, *range(40)]), r.choice("uv")) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, o int, mark string")
    near = {x.id: (x.before, x.after) for x in linked(df, "g", "o", "id", width=7).collect()}
    number = {x.id: x.n for x in numbered(df, ["g"], "o", "id", "n", width=7).collect()}
    marks = [("a", 3, "x"), ("a", 3, "y"), ("a", 30, "z"), ("b", 0, "w")]
    last = {x.id: x.mark for x in last_before(df.drop("mark"), spark.createDataFrame(marks, "g string, o int, mark string"), "g", "o", width=7).collect()}
    for g in "ab":
        ids = [i for i, _, _, _ in sorted((x for x in rows if x[1] == g), key=lambda x: (-1 if x[2] is None else x[2], x[0]))]
        assert [near[i] for i in ids] == list(zip([None, *ids], [*ids[1:], None]))
        assert [number[i] for i in ids] == list(range(1, len(ids) + 1))
    for i, g, o, _ in rows:
        want = [m for h, at, m in marks if h == g and o is not None and at <= o]
        assert last.get(i) == (want[-1] if want else None)
    assert linked(df.where("false"), "g", "o", "id").count() == 0


def test_greedy_diversity_against_the_definition(spark):
    r = random.Random(8)
    hits = [(q, i, r.random(), r.sample("abcdefgh", 4)) for q in range(3) for i in range(20)]
    df = spark.createDataFrame(hits, "qid long, id long, fused double, tokens array<string>")
    got = {}
    for x in U.diversified(df, "long", 0.3, 10).orderBy("qid", "place").collect():
        got.setdefault(x.qid, []).append(x.id)
    for q in range(3):
        own = {i: (f, set(t)) for p, i, f, t in hits if p == q}
        taken = []
        while len(taken) < 10:
            worth = lambda i: 0.3 * own[i][0] - 0.7 * max((len(own[i][1] & own[j][1]) / len(own[i][1] | own[j][1]) for j in taken), default=0)
            taken.append(max((i for i in own if i not in taken), key=worth))
        assert got[q] == taken


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_of_a_hub(spark):
    e = spark.range(1, 3000).selectExpr("0L as a", "id as b")
    got = connected_components(e, "a", "b")
    assert got.where("component = 0").count() == 3000


def test_block_pairs_meet_once(spark):
    r = spark.range(25).selectExpr("'k' as key", "id").unionByName(spark.createDataFrame([("s", 1), ("s", 2)], "key string, id long"))
    seen = []
    groups = {}
    for x in block_pairs(r, "key", "id", 5).collect():
        groups.setdefault((x.key, x.bi, x.bj), []).append((x.id, x.blk))
    for (key, bi, bj), members in groups.items():
        for i, (a, p) in enumerate(members):
            for b, q in members[i + 1 :]:
                if bi == bj or p != q:
                    seen.append((key, min(a, b), max(a, b)))
    assert sorted(seen) == sorted([("k", a, b) for a in range(25) for b in range(a + 1, 25)] + [("s", 1, 2)])


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 3, "w"), ("c", 1, "p"), ("c", 1, "p")], "id string, v int, t string")
    assert sorted((r.id, r.t) for r in latest_rows(df, ["id"], "v").collect()) == [("a", "y"), ("b", "z"), ("c", "p")]


def test_parse_analysis(spark):
    df = spark.createDataFrame([('{"intent":"nonsense","keyword_query":" ","content":"topic","time_range":{"start":2019},"authors":["A","B"],"recency":"recent","qualifiers":["popular","x"],"domains":{"main":"cs.CL"}}', "asked"), ("broken", "asked"), (None, "asked")], "raw string, q string")
    a, b, c = (r.x for r in df.select(parse_analysis(F.col("raw"), F.col("q")).alias("x")).collect())
    assert (a.intent, a.keyword_query, a.year_min, a.author, a.field_of_study, a.qualifiers) == ("find_papers", "topic", 2019, "A, B", "cs.cl", ["popular", "recent"])
    assert (b.intent, b.keyword_query) == ("find_papers", "asked") and c.semantic_query == "asked"


def test_keyword_queries(spark):
    q = spark.createDataFrame([(1, "Which method does Dense Retrieval use", ["retrieval", "passages"], ["Method", "Results"])], "qid long, text string, ranked array<string>, sections array<string>")
    got = {r.number: r for r in keyword_queries(q).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert got[0].boosted == [] and "Dense Retrieval" in got[0].normal
    assert got[1].boosted == ["Dense Retrieval", "retrieval"] and got[3].section == "Method" and got[4].section == "Results"
    assert "method" not in [t.lower() for t in got[2].boosted]


def _chunks(spark):
    return spark.createDataFrame([(1, "dense vectors for search", "Method", ["Method"], [1.0, 0.0]), (2, "sparse words for search", "References", ["References"], [0.9, 0.1]), (3, "nothing alike", "Appendix", [], [0.0, 1.0])], "id long, text string, section_title string, headings array<string>, vector array<float>")


def test_chunk_search(spark):
    q = spark.createDataFrame([(7, 0, "dense search", [1.0, 0.0]), (7, 1, "vectors", [1.0, 0.0])], "qid long, number int, text string, vector array<float>")
    got = P.chunk_search(_chunks(spark), q).orderBy("rank").collect()
    assert got[0].id == 1 and {r.id for r in got} == {1, 2, 3}
    assert got[-1].id == 2  # penalised section
    d = P.chunk_search(_chunks(spark), q, P.SearchConfig(diversify=True, results=2)).collect()
    assert len(d) == 2 and len({r.id for r in d}) == 2


def test_paper_search_filters_before_the_cut(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0], "2019-01-01"), (2, [0.9, 0.1], "2021-01-01"), (3, [0.0, 1.0], "2022-05-05")], "id long, vector array<float>, update_date string")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, v array<float>")
    assert [r.id for r in P.paper_search(p, q, k=1, year_min=2020).collect()] == [2]
    assert P.paper_search(p, q, k=1, year_min=2020, strict_order=True).count() == 0


def test_paper_search_finds_matches_however_far(spark):
    p = spark.createDataFrame([(i, [1.0, i / 100], "2021-01-01" if i >= 50 else "2019-01-01") for i in range(70)], "id long, vector array<float>, update_date string")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, v array<float>")
    got = P.paper_search(p, q, k=15, year_min=2020).orderBy("rank").collect()
    assert [r.id for r in got] == list(range(50, 65)) and [r["rank"] for r in got] == list(range(1, 16))
    assert set(got[0].asDict()) == set(P.paper_search(p, q, k=1, fetch=70).first().asDict())


def test_diversification_sees_every_list(spark):
    chunks = spark.createDataFrame([(i, f"word{i}", "Method", ["Method"], [1.0, 0.0]) for i in range(6)], "id long, text string, section_title string, headings array<string>, vector array<float>")
    q = spark.createDataFrame([(7, i, f"word{i}", None) for i in range(6)], "qid long, number int, text string, vector array<float>")
    got = P.chunk_search(chunks, q, P.SearchConfig(lexical=1, semantic=1, results=6, diversify=True)).collect()
    assert {r.id for r in got} == set(range(6))


def test_parent_search(spark):
    c = spark.createDataFrame([(1, "p", [1.0, 0.0]), (2, "p", [0.8, 0.2]), (3, "q", [0.9, 0.0])], "id long, parent string, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, v array<float>")
    assert [(r.parent, r.child) for r in P.parent_search(c, q, 2).orderBy("rank").collect()] == [("p", 1), ("q", 3)]


def test_rank_by_lists(spark):
    a = spark.createDataFrame([(0, 0, "1. b text"), (0, 1, "2) a text"), (0, 2, "unknown"), (0, 3, "3. b text")], "qid long, pos int, line string")
    k = spark.createDataFrame([(0, 10, "a text"), (0, 11, "b text")], "qid long, id long, text string")
    assert [(r.id, r["rank"]) for r in P.rank_by_lists(a, k).orderBy("rank").collect()] == [(11, 1), (10, 2)]
