"""Rank fusion, source mixtures and abuse scores."""

import random

import numpy as np
import pytest

from papyra.llm.abuse import AbuseScores, best_threshold, labelled, learnt, marked, plain_words, thresholds
from papyra.llm.fusion import candidate_scores, fuse_ranks
from papyra.llm.mixture import Mixture
from papyra.llm.queries import TOKENIZER as VOCABULARY


def test_fusion(frame):
    rows = [(1, "a", "x", 10.0), (1, "b", "x", 5.0), (1, "a", "y", -3.0), (1, "b", "y", -1.0), (1, "c", "y", -1.0), (1, "d", "x", None), (1, "a", "x", 2.0), (None, "a", "x", 1.0), (2, "e", "x", float("nan"))]
    got = {(r.q, r.i): (r.fused_score, r["rank"]) for r in fuse_ranks(frame(rows, "q long, i string, list string, score double"), "q", "i").collect()}
    assert got[1, "b"] == (pytest.approx(1 / 62 + 1 / 61), 1)
    assert got[1, "a"] == (pytest.approx(1 / 61 + 1 / 63), 2)
    assert got[1, "c"] == (pytest.approx(1 / 61), 3)
    assert got[1, "d"] == (0.0, 4) and got[2, "e"] == (0.0, 1)
    assert fuse_ranks(frame([], "q long, i string, list string, score double"), "q", "i").count() == 0


def test_scale_does_not_matter(frame):
    r = random.Random(4)
    rows = [(1, f"i{k}", name, r.random()) for k in range(30) for name in ("x", "y", "z")]
    grown = [(q, i, n, v * 1e6 - 5 if n == "y" else v) for q, i, n, v in rows]
    order = lambda rs: [x.i for x in fuse_ranks(frame(rs, "q long, i string, list string, score double"), "q", "i").orderBy("rank").collect()]
    assert order(rows) == order(grown)


def test_candidates(frame):
    rows = [(1, "a", {"l": 1.0}, None, None, 0), (1, "a", {"l": 1.0}, None, None, 0), (1, "b", None, 0.5, None, 0), (1, "c", {}, None, None, 0), (None, "a", {"l": 1.0}, None, None, 0)]
    got = sorted(((r.chunk_id, r["list"], r.score) for r in candidate_scores(frame(rows, "query_id long, chunk_id string, lexical_scores map<string,double>, semantic_score double, logged_at timestamp, list int")).collect()), key=str)
    assert got == sorted([("a", "lexical:l", 1.0), ("a", "semantic", None), ("b", "semantic", 0.5), ("c", "semantic", None)], key=str)


DOCS, TARGETS, WEIGHTS = "doc_id long, source string, text string, tokens int", "source string, target_share double, max_repeats int", "doc_id long, weight double"


def test_mixture_meets_targets(frame):
    r = random.Random(5)
    docs = [(i, "big" if i < 600 else "small", "word " * r.randint(5, 60), 1) for i in range(700)] + [(i, "other", "word", 1) for i in range(900, 920)]
    m = Mixture(frame(docs, DOCS), frame([("big", 0.5, 1), ("small", 0.3, 3), ("gone", 0.2, 4)], TARGETS), frame([], WEIGHTS), VOCABULARY, bucket_rows=50)
    share = {x.source: x for x in m.shares().collect()}
    assert share["big"].actual_share == pytest.approx(0.5 / 0.8, abs=0.01) and share["small"].actual_share == pytest.approx(0.3 / 0.8, abs=0.01)
    assert share["gone"].mixed_tokens == 0 and share["gone"].available_tokens == 0
    taken = m.documents().collect()
    assert all(x.repeats <= {"big": 1, "small": 3}[x.source] for x in taken)
    reps = [x.repeats for x in taken if x.source == "small"]
    assert max(reps) - min(reps) <= 1 and len(reps) == 100  # complete epochs come first
    assert sorted((x.doc_id, x.repeats) for x in taken) == sorted((x.doc_id, x.repeats) for x in m.documents().collect())


def test_weights_favour_documents(frame):
    docs = [(i, "s", "one two three four", 1) for i in range(2000)]
    m = Mixture(frame(docs, DOCS), frame([("s", 1.0, 1)], TARGETS), frame([(i, 4.0 if i % 2 else 1.0) for i in range(2000)], WEIGHTS), VOCABULARY, total_tokens=1600, bucket_rows=100)
    got = [r.doc_id for r in m.documents().collect()]
    tokens = {r.tokens for r in m.documents().collect()}
    assert abs(len(got) * tokens.pop() - 1600) < 10
    assert sum(d % 2 for d in got) / len(got) > 0.7


def test_mixture_of_odd_rows(frame):
    docs = [(1, "s", "a b c", 1), (1, "s", "a b c", 1), (2, "s", None, 1), (None, "s", "x", 1), (3, None, "x", 1), (4, "s", "", 1), (5, "t", "x", 1)]
    m = Mixture(frame(docs, DOCS), frame([("s", 1.0, 2), ("s", 1.0, 2), (None, 0.5, 1), ("u", None, None)], TARGETS), frame([(1, None), (1, -1.0), (None, 2.0)], WEIGHTS), VOCABULARY)
    assert {(r.doc_id, r.repeats) for r in m.documents().collect()} == {(1, 2), (4, 2)}
    e = Mixture(frame([], DOCS), frame([("s", 1.0, 2)], TARGETS), frame([], WEIGHTS), VOCABULARY)
    assert e.documents().count() == 0 and e.shares().first().actual_share == 0
    n = Mixture(frame(docs, DOCS), frame([], TARGETS), frame([], WEIGHTS), VOCABULARY)
    assert n.documents().count() == 0 and n.shares().count() == 0


@pytest.mark.parametrize("text,want", [("stuuuupid", "stupid"), ("1d107", "idiot"), ("kіll", "kill"), ("ro​tten", "rotten"), ("d.a.m.n", "damn"), ("tashkoï", "tashkoi"), ("2019", "0"), ("i***t", "i***t")])
def test_disguises(text, want):
    assert plain_words(text) == [want]


LABELS, TEXTS = "doc_id long, toxic int", "doc_id long, text string, lang string, source string, score int"


def corpus(n, seed):
    r = random.Random(seed)
    calm = ["the baseline {} reaches {} points", "a stupid baseline {} is enough for {}", "annotators marked the word idiot in {} of {} papers", "the filter kills the {} process of {}"]
    rude = ["you {} idiot go away", "shut up you stupid {}", "kill yourself {} nobody likes you"]
    out = []
    for i in range(n):
        s = [r.choice(calm).format(f"w{r.randint(0, 300)}", f"w{r.randint(0, 300)}") for _ in range(r.randint(1, 12))]
        bad = r.random() < 0.3
        if bad:
            s.insert(r.randrange(len(s) + 1), r.choice(rude).format(f"w{r.randint(0, 300)}"))
        out.append((i, ". ".join(s), "en", "a" if i % 2 else None, bad))
    return out


def test_abuse_held_out(frame):
    docs = corpus(900, 1)
    r = random.Random(2)
    labels = [(i, int(bad) if r.random() > 0.05 else int(not bad)) for i, _, _, _, bad in docs[:500]] + [(0, None), (None, 1)]
    a = AbuseScores(frame([(*d[:4], 1) for d in docs], TEXTS), frame(labels, LABELS))
    flagged = {x.doc_id for x in a.scores.where("flagged").collect()}
    want = {d[0] for d in docs[500:] if d[4]}
    got = {i for i in flagged if i >= 500}
    assert len(got & want) / len(want) > 0.9 and len(got & want) / max(1, len(got)) > 0.9
    rates = {x.source: x for x in a.rates().collect()}
    assert set(rates) == {"a", None} and rates["a"].documents == 450 and 0 < rates["a"].rate < 1


def test_abuse_of_odd_rows(frame):
    docs = [(1, None, None, None, 1), (2, "", "en", "s", 1), (3, "word " * 50_000, "xx", "s", 1), (None, "x", "en", "s", 1), (3, "word", "xx", "s", 1)]
    for labels in ([], [(1, 1)], [(2, 0), (3, 1)], [(2, 0), (2, 1)]):
        a = AbuseScores(frame(docs, TEXTS), frame(labels, LABELS))
        got = a.scores.collect()
        assert sorted(r.doc_id for r in got) == [1, 2, 3, 3] and all(np.isfinite(r.score) for r in got)
    assert AbuseScores(frame([], TEXTS), frame([], LABELS)).scores.count() == 0


def test_threshold_lies_in_the_gap_whatever_the_share_of_cases():
    r = np.random.default_rng(3)
    for cases in (20, 200, 1000):
        corpus = np.concatenate([r.beta(2, 8, 10_000), r.beta(30, 2, cases)])
        positive = np.concatenate([r.beta(30, 2, 80), r.beta(2, 8, 20)])  # a fifth of the labels are wrong
        assert 0.7 < best_threshold(positive, corpus) < 0.95
    assert best_threshold(np.array([0.9]), np.array([0.1])) > 0.1


def test_training_texts_are_bounded_in_bytes(frame):
    docs = frame([(i, "word " * (2000 if i == 3 else 20), "en", "s") for i in range(20)], "doc_id long, text string, lang string, source string")
    marks = frame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    texts, y, langs, ids = labelled(docs, marks, 100, 4000)
    assert sum(map(len, texts)) <= 4000 and all(len(t) < 4000 for t in texts) and len(texts) == len(y) == len(langs) > 5 and ids.count() == 20


def test_letters_apart():
    assert plain_words("so n a k e d b*****s, x y z") == ["so", "naked", "b*****s", "x", "y", "z"]


def test_every_label_is_learnt(frame):
    docs = frame([(i, f"word w{i % 50}", None, "s") for i in range(5000)], "doc_id long, text string, lang string, source string")
    marks = frame([(i, int(i % 5 == 0)) for i in range(4500)], "doc_id long, toxic int")
    ids, langs, y, words, rows = learnt(marked(docs, marks)[0])
    assert ids.tolist() == list(range(4500)) and y.sum() == 900 and set(langs) == {""}
    assert all(len(d) == 2 for d in words) and len(rows) == 52 and len({int(d[1]) for d in words}) == 50


def test_thresholds_are_set_in_the_whole_corpus(frame):
    docs = corpus(400, 3)
    a = AbuseScores(frame([(*d[:4], 1) for d in docs], TEXTS), frame([(d[0], int(d[4])) for d in docs], LABELS))
    got, want = {r.doc_id for r in a.scores.where("flagged").collect()}, {d[0] for d in docs if d[4]}
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9  # all are labelled, none is left out


def test_thresholds_equal_the_best_of_all_cuts(frame):
    def best_of_all(positive, all_):
        pos, all_ = np.sort(positive), np.sort(all_)
        cuts = np.unique(np.concatenate([pos, all_]))
        recall = (len(pos) - np.searchsorted(pos, cuts)) / len(pos)
        flagged = (len(all_) - np.searchsorted(all_, cuts) + 1) / (len(all_) + 1)
        use = recall >= 0.2
        share = (flagged[use] / recall[use]).min()
        f1 = 2 * share * recall / (flagged + share)
        k = int(np.flatnonzero(f1 >= f1.max() - max(0.005, 1 / len(pos)))[-1])
        below = np.searchsorted(all_, cuts[k])
        return (cuts[k] + (all_[below - 1] if below else 0.0)) / 2

    r = np.random.default_rng(8)
    for n in (3, 40, 300):
        score = {"en": np.concatenate([r.beta(2, 8, 500), r.beta(9, 2, n)]).round(3), "de": r.beta(2, 5, 200), None: r.beta(1, 3, 20)}
        positive = {"": r.beta(6, 2, n).round(3), "en": r.beta(8, 3, n).round(3), "fr": r.beta(8, 3, 5)}
        got = thresholds(frame([(k, float(x)) for k, v in score.items() for x in v], "lang string, score double"), positive)
        everything = np.concatenate(list(score.values()))
        assert got == {"": pytest.approx(best_of_all(positive[""], everything)), "en": pytest.approx(best_of_all(positive["en"], score["en"]))}
        assert got["en"] == pytest.approx(best_threshold(positive["en"], score["en"]))


def test_labels_are_learnt_in_shards(frame):
    docs = corpus(900, 1)
    labels = [(i, int(bad)) for i, _, _, _, bad in docs[:500]]
    a = AbuseScores(frame([(*d[:4], 1) for d in docs], TEXTS), frame(labels, LABELS), gathered=5000)
    flagged, want = {x.doc_id for x in a.scores.where("flagged").collect()}, {d[0] for d in docs if d[4]}
    assert len(flagged & want) / len(want) > 0.9 and len(flagged & want) / max(1, len(flagged)) > 0.9
