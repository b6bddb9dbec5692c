import random

import numpy as np

from papyra.llm.leakage import FmIndex, WaveletMatrix, leaked_spans, suffix_array
from papyra.llm.words import words

DOCS, ITEMS = "doc_id long, text string, item_id int", "item_id long, text string, doc_id int"


def runs(r, n, symbols):
    out = []
    while len(out) < n:
        out += [r.randint(1, symbols - 1) for _ in range(r.randint(1, 20))] + [0]
    return np.array(out)


def test_suffix_array_and_rank():
    r = random.Random(0)
    for symbols in (2, 3, 17):
        t = runs(r, 300, symbols)
        ends = [i + list(t[i:]).index(0) for i in range(len(t))]
        key = lambda i: (list(t[i : ends[i]]) + [0], ends[i])
        want = sorted(range(len(t)), key=lambda i: [(x, 0) for x in key(i)[0][:-1]] + [(0, ends[i])])
        assert list(suffix_array(t)) == want
        w = WaveletMatrix(t, symbols)
        for c in range(symbols):
            at = np.arange(len(t) + 1)
            assert list(w.rank(np.full(len(at), c), at)) == [int((t[:k] == c).sum()) for k in at]


def test_search_and_locate():
    r = random.Random(1)
    t = runs(r, 800, 4)
    ix = FmIndex(t, 4, every=8)
    for width in (1, 2, 3):
        p = np.array([[r.randint(1, 3) for _ in range(width)] for _ in range(20)])
        lo, hi = ix.search(p)
        for q, a, b in zip(p, lo, hi):
            want = [i for i in range(len(t) - width + 1) if list(t[i : i + width]) == list(q)]
            assert sorted(ix.locate(np.arange(a, b))) == want


def brute(docs, items, width):
    out = set()
    for d, text in docs:
        w = words(text)
        g = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        for i, q in items:
            v = words(q)
            if any(tuple(v[k : k + width]) in g for k in range(len(v) - width + 1)):
                out.add((d, i))
    return out


def test_equals_brute_force(frame):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 40)))) for i in range(30)]
    docs = []
    for d in range(240):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        if d % 3 == 0:
            q = words(items[r.randrange(30)][1])
            cut = r.randint(0, max(0, len(q) - 12))
            w[10:10] = [x.upper() + "," for x in q[cut : cut + r.randint(8, 16)]]
        docs.append((d, "  ".join(w)))
    want = brute(docs, items, 12)
    assert len(want) > 10
    for shard in (50, 1_000_000):
        got = leaked_spans(frame([(*x, 1) for x in docs], DOCS), frame([(*x, 1) for x in items], ITEMS), shard_words=shard)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    two = leaked_spans(frame([(*x, 1) for x in docs], DOCS), frame([(*x, 1) for x in items], ITEMS), block_items=7)
    assert {(r.doc_id, r.item_id) for r in two.collect()} == want


def test_spans(frame):
    item = " ".join(f"t{i}" for i in range(20))
    text = "İ intro. " + item.upper().replace(" ", ", ") + " tail " + " ".join(f"t{i}" for i in range(3, 15))
    got = leaked_spans(frame([(1, text, 0)], DOCS), frame([(5, item, 0)], ITEMS)).orderBy("word_start").collect()
    assert len(got) == 2
    assert words(text[got[0].char_start : got[0].char_end]) == words(item)
    assert words(text[got[1].char_start : got[1].char_end]) == [f"t{i}" for i in range(3, 15)]


def test_odd_rows(frame):
    item = " ".join(f"t{i}" for i in range(15))
    docs = [(1, None, 0), (None, item, 0), (2, "", 0), (3, item, 0), (3, item, 0), (4, "q " * 300_000 + item, 0)]
    items = [(7, item, 0), (8, item, 0), (9, None, 0), (None, item, 0), (10, "short", 0), (7, item, 0)]
    got = {(r.doc_id, r.item_id) for r in leaked_spans(frame(docs, DOCS), frame(items, ITEMS)).collect()}
    assert got == {(d, i) for d in (3, 4) for i in (7, 8)}
    assert leaked_spans(frame([], DOCS), frame(items, ITEMS)).count() == 0
    assert leaked_spans(frame(docs, DOCS), frame([], ITEMS)).count() == 0
