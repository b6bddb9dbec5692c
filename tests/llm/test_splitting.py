import random
from datetime import datetime

from papyra.llm.splitting import cuts, TOKEN, split_oversized

CHUNKS = "id string, text string, section_title string, config_id int, ingested_at timestamp, lim int"
CONFIGS = "config_id int, tokens_per_chunk int, overlap_tokens int, min_chunk_tokens int, default_section_title string, text string"


def prose(n, seed=0):
    r = random.Random(seed)
    out = []
    while n > 0:
        k = min(n, r.randint(4, 15))
        out.append(" ".join(f"w{r.randint(0, 50)}" for _ in range(k)) + ".")
        n -= k
    return "  ".join(out)


def test_cuts_respect_limit_overlap_and_order():
    for n, limit, overlap in ((100, 30, 5), (1000, 160, 40), (33, 10, 9), (50, 1, 0), (300, 60, 0)):
        text = prose(n)
        spans = [m.span() for m in TOKEN.finditer(text)]
        got = cuts(text, spans, limit, overlap, 4)
        assert got[0][0] == 0 and got[-1][1] == len(spans)
        assert all(0 < e - s <= limit for s, e in got)
        assert all(b[0] == a[1] - overlap for a, b in zip(got, got[1:]))


def test_cuts_stand_at_sentence_ends():
    text = prose(600)
    spans = [m.span() for m in TOKEN.finditer(text)]
    got = cuts(text, spans, 80, 10, 10)
    assert all(text[spans[e - 1][1] - 1] == "." for _, e in got)


def test_a_topic_change_attracts_the_cut():
    a = " ".join(f"alpha{i % 7} beta{i % 5} gamma{i % 3}." for i in range(20))
    b = " ".join(f"delta{i % 7} omega{i % 5} theta{i % 3}." for i in range(30))
    text = a + " " + b
    spans = [m.span() for m in TOKEN.finditer(text)]
    assert cuts(text, spans, 80, 0, 10)[0][1] == 60


def test_pieces(frame):
    text = prose(100)
    none = "x " * 120
    rows = [("a", text, " ", 1, None, 5), ("a", text, " ", 1, None, 6), ("short", "few words", "T", 1, None, 5), ("b", none, "T", 1, None, 5), ("n", None, "T", 1, None, 5), (None, text, "T", 1, None, 5), ("u", text, "T", 9, None, 5), ("v", text, "T", None, None, 5), ("e", "", "T", 1, None, 5), ("z", text, "T", 2, None, 5), ("long", prose(30_000), "T", 1, None, 5)]
    configs = [(1, 40, 8, 5, "Body", "c"), (1, 40, 8, 5, "Body", "c"), (2, 0, 0, 0, "Body", "c"), (3, None, None, None, None, None)]
    got = {}
    for r in split_oversized(frame(rows, CHUNKS), frame(configs, CONFIGS)).orderBy("chunk_id", "piece").collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert set(got) == {"a", "b", "long"}
    for i, whole in (("a", text), ("b", none)):
        parts = got[i]
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert all(p.token_count == len(p.text.split()) <= 40 and whole[p.char_start : p.char_end] == p.text for p in parts)
        assert all(x.text.split()[-8:] == y.text.split()[:8] for x, y in zip(parts, parts[1:]))
    assert {p.section_title for p in got["a"]} == {"Body"} and {p.section_title for p in got["b"]} == {"T"}
    assert sum(p.token_count - 8 for p in got["long"]) + 8 == 30_000


def test_empty(frame):
    assert split_oversized(frame([], CHUNKS), frame([], CONFIGS)).count() == 0


def test_a_newer_short_delivery_leaves_no_pieces(frame):
    rows = [("a", prose(100), "T", 1, datetime(2024, 1, 1), 5), ("a", "short now", "T", 1, datetime(2024, 2, 1), 5), ("b", "short before", "T", 1, datetime(2024, 1, 1), 5), ("b", prose(100), "T", 1, datetime(2024, 2, 1), 5)]
    got = split_oversized(frame(rows, CHUNKS), frame([(1, 40, 8, 5, "Body", "c")], CONFIGS))
    assert {r.chunk_id for r in got.collect()} == {"b"}


def test_the_deepest_valley_counts_also_where_no_sentence_ends():
    a, b = " ".join(f"alpha{i % 7} beta{i % 5}" for i in range(25)), " ".join(f"delta{i % 7} omega{i % 5}" for i in range(40))
    text = a + " " + b
    spans = [m.span() for m in TOKEN.finditer(text)]
    assert abs(cuts(text, spans, 80, 0, 10)[0][1] - 50) <= 2
