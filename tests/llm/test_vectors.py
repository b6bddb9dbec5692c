"""Nearest vectors against brute force, and the cases that must not break it."""

import numpy as np
from pyspark.sql import functions as F

from papyra.llm.vectors import IvfPq, SimilarVectors

SCHEMA = "id string, vector array<float>, ver timestamp, note string"


def clustered(n=400, dims=64, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 8, dims))
    x = centres[r.integers(0, len(centres), n)] + r.normal(scale=0.15, size=(n, dims))
    return x.astype(np.float32)


def truth(x, k, floor):
    v = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(s)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= floor:
                out.add((min(i, j), max(i, j)))
    return out


def pairs(df):
    return {(min(int(r.id), int(r.neighbour)), max(int(r.id), int(r.neighbour))) for r in df.collect()}


def test_recall_against_brute_force(frame):
    x = clustered()
    df = frame([(str(i), v.tolist(), None, "x") for i, v in enumerate(x)], SCHEMA)
    want = truth(x, 5, 0.9)
    got = pairs(SimilarVectors(df, k=5, min_similarity=0.9).neighbours())
    assert len(want) > 300
    assert len(got & want) / len(want) > 0.98
    assert len(got - want) / len(got) < 0.02


def test_blocks_of_a_hot_cell_lose_nothing(frame):
    x = clustered(300)
    df = frame([(str(i), v.tolist(), None, "x") for i, v in enumerate(x)], SCHEMA)
    want = truth(x, 5, 0.9)
    got = pairs(SimilarVectors(df, k=5, min_similarity=0.9, cells=1, block_rows=40).neighbours())
    assert len(got & want) / len(want) > 0.98


def test_a_crowd_of_near_vectors_is_reranked_whole(frame):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(1, 64)) + r.normal(scale=0.05, size=(150, 64)), r.normal(size=(150, 64))]).astype(np.float32)
    df = frame([(str(i), v.tolist(), None, "x") for i, v in enumerate(x)], SCHEMA)
    want = truth(x, 5, 0.9)
    got = pairs(SimilarVectors(df, k=5, min_similarity=0.9).neighbours())
    assert len(got & want) / len(want) > 0.98 and len(got - want) / len(got) < 0.02


def test_unusable_equal_and_repeated_rows(frame):
    a, b = [1.0] + [0.0] * 63, [0.0, 1.0] + [0.0] * 62
    rows = [(f"c{i}", a, None, "x") for i in range(9)] + [("near", [1.0, 0.01] + [0.0] * 62, None, "x"), ("far", b, None, "x"), ("far", b, None, "x")]
    rows += [("null", None, None, "x"), ("short", [1.0], None, "x"), ("zero", [0.0] * 64, None, "x"), ("nan", [float("nan")] + [1.0] * 63, None, "x"), ("inf", [float("inf")] + [1.0] * 63, None, "x"), (None, a, None, "x"), ("holes", [None] + [1.0] * 63, None, "x")]
    got = {}
    for r in SimilarVectors(frame(rows, SCHEMA), k=5, min_similarity=0.5).neighbours().orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got["c0"] == ["c1", "c2", "c3", "c4", "c5"]
    assert got["c8"] == ["c0", "c1", "c2", "c3", "c4"]
    assert got["near"] == ["c0", "c1", "c2", "c3", "c4"]
    assert set(got) == {f"c{i}" for i in range(9)} | {"near"}


def test_no_usable_vectors(frame):
    assert SimilarVectors(frame([], SCHEMA)).neighbours().count() == 0
    assert SimilarVectors(frame([("a", [1.0], None, "x")], SCHEMA)).neighbours().count() == 0
    assert SimilarVectors(frame([("a", [1.0] * 64, None, "x")], SCHEMA)).neighbours().count() == 0


def test_table_scores_are_inner_products_with_the_decoded_vectors():
    x = clustered(300, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ix = IvfPq.fit(x, 4, 16)
    cell = (x @ ix.centroids.T).argmax(1)
    own = np.flatnonzero(cell == cell[0])
    codes = ix.encode(x[own], cell[own])
    decoded = ix.centroids[cell[0]] + np.concatenate([ix.books[m][codes[:, m]] for m in range(16)], axis=1)
    np.testing.assert_allclose(ix.scores(x[:7], cell[0], codes), decoded @ x[:7].T, atol=1e-4)


def test_latest_delivery_counts(spark):
    a, b = "array(1.0F" + ", 0.0F" * 63 + ")", "array(0.0F, 1.0F" + ", 0.0F" * 62 + ")"
    df = spark.sql(f"select 'p' id, {a} vector, timestamp'2024-01-01' ver union all select 'p', {b}, timestamp'2024-02-01' union all select 'q', {b}, timestamp'2024-01-01'")
    got = SimilarVectors(df, min_similarity=0.9).neighbours().select("id", F.round("similarity", 4).alias("s")).collect()
    assert sorted(tuple(r) for r in got) == [("p", 1.0), ("q", 1.0)]


def test_every_vector_gets_its_neighbours_however_far(spark, tmp_path):
    from papyra.llm.queries import p1_neighbours

    x = np.random.default_rng(8).normal(size=(3000, 64)).astype(np.float32)
    rows = [(f"{i:05d}", v.tolist(), None) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "id string, specter2_vec array<float>, ingested_at timestamp").coalesce(1).write.parquet(str(tmp_path / "chunks.parquet"))
    got = p1_neighbours(spark, str(tmp_path)).collect()
    assert len(got) == 5 * len(x) and max(r.similarity for r in got) < 0.9


def test_recall_over_all_similarities_by_default_probes(frame):
    r = np.random.default_rng(9)
    x = (r.normal(size=(12, 64))[r.integers(0, 12, 4000)] + 2 * r.normal(size=(4000, 10)) @ r.normal(size=(10, 64)) / 3).astype(np.float32)
    df = frame([(str(i), v.tolist(), None, "x") for i, v in enumerate(x)], SCHEMA)
    want = truth(x, 5, -1)
    got = pairs(SimilarVectors(df, k=5, block_rows=500).neighbours())
    assert len(got & want) / len(want) > 0.9
