import random

from papyra.llm.near_dup import DEEPEST, NearDuplicates, found_share, jaccard, prefix_depth
from papyra.llm.words import words

SCHEMA = "kind string, id string, text string, ver timestamp, extra int"


def grams(t, n=3):
    w = words(t)
    return set(zip(*[w[k:] for k in range(n)]))


def corpus(seed=1, bases=30, edits=5, length=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for b in range(bases):
        base = [r.choice(vocabulary) for _ in range(length)]
        out.append(base)
        for _ in range(edits):
            t = list(base)
            for _ in range(r.randint(1, 4)):
                t[r.randrange(length)] = r.choice(vocabulary)
            out.append(t)
    return [" ".join(t) for t in out]


def truth(texts, limit):
    g = [grams(t) for t in texts]
    return {(f"d{i:04d}", f"d{j:04d}") for i in range(len(g)) for j in range(i + 1, len(g)) if jaccard(g[i], g[j]) >= limit}


def test_prefix_depth_reaches_the_target():
    for s in (0.5, 0.8):
        d = prefix_depth(s, 48, 0.95)
        assert 1 - (1 - s**d) ** 48 >= 0.95
        assert d == DEEPEST or found_share(s, d + 1, 48) < 0.95


def test_prefixes_are_shortened_while_links_are_dissimilar(frame):
    """Pairs near the limit make the walk go on with shorter prefixes, and their recall is that of the target."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(20_000)]
    texts = []
    for i in range(300):
        base = [r.choice(vocabulary) for _ in range(100)]
        t = list(base)
        for k in r.sample(range(98), 10):
            t[k] = r.choice(vocabulary)
        texts += [" ".join(base), " ".join(t)]
    df = frame([("k", f"d{i:04d}", t, None, 1) for i, t in enumerate(texts)], SCHEMA)
    g = [grams(t) for t in texts]
    want = {(f"d{i:04d}", f"d{i + 1:04d}") for i in range(0, len(g), 2) if jaccard(g[i], g[i + 1]) >= 0.5}
    assert len(want) > 60
    got = {(x.id_a, x.id_b) for x in NearDuplicates(df, 0.5, 3, 30).pairs().collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_pairs_against_brute_force(frame):
    texts = corpus()
    df = frame([("k", f"d{i:04d}", t, None, 1) for i, t in enumerate(texts)], SCHEMA)
    want = truth(texts, 0.5)
    got = {(r.id_a, r.id_b) for r in NearDuplicates(df, 0.5, 3, 30).pairs().collect()}
    assert got <= want
    assert len(got) / len(want) > 0.97


def test_oversized_nodes_give_the_same_pairs(frame):
    texts = corpus(3, 10, 8)
    df = frame([("k", f"d{i:04d}", t, None, 1) for i, t in enumerate(texts)], SCHEMA)
    a = {(r.id_a, r.id_b) for r in NearDuplicates(df, 0.5, 3, 30).pairs().collect()}
    b = {(r.id_a, r.id_b) for r in NearDuplicates(df, 0.5, 3, 30, node_rows=2, block_rows=3).pairs().collect()}
    assert a == b
    c = {(r.id_a, r.id_b) for r in NearDuplicates(df, 0.5, 3, 30, node_rows=2, block_rows=3, crowd_part=1, crowd_rows=4).pairs().collect()}
    assert a == c


def test_groups_copies_kinds_and_odd_rows(frame):
    base = " ".join(f"w{i}" for i in range(40))
    near = base.replace("w5", "x5")
    rows = [("k", f"c{i}", base.upper() + "!", None, 1) for i in range(4)] + [("k", "e", near, None, 1), ("k", "e", near, None, 2), ("other", "c9", base, None, 1)]
    rows += [("k", "n", None, None, 1), (None, "m", base, None, 1), ("k", None, base, None, 1), ("k", "s", "too short", None, 1), ("k", "b", "", None, 1), ("k", "long", "z " * 200_000, None, 1)]
    nd = NearDuplicates(frame(rows, SCHEMA), 0.5, 3, 30)
    got = {(r.kind, r.id): (r.class_id, r.group_id, r.links) for r in nd.groups().collect()}
    assert {r.copies for r in nd.groups().where("class_id = 'c0'").collect()} == {4}
    assert got == {**{("k", f"c{i}"): ("c0", "c0", 1) for i in range(4)}, ("k", "e"): ("e", "c0", 1), ("other", "c9"): ("c9", "c9", 0), ("k", "long"): ("long", "long", 0)}
    assert {(r.id_a, r.id_b) for r in nd.pairs().collect()} == {(a, b) for a in ("c0", "c1", "c2", "c3") for b in ("c0", "c1", "c2", "c3", "e") if a < b}
    few = {(r.id_a, r.id_b) for r in nd.pairs(expand_copies=2).collect()}
    assert few == {("c0", "c1"), ("c0", "c2"), ("c0", "c3"), ("c0", "e")}


def test_empty_table(frame):
    nd = NearDuplicates(frame([], SCHEMA), 0.5, 3, 30)
    assert nd.pairs().count() == 0 and nd.groups().count() == 0
