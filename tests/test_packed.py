import pytest

from papyra.operators.packed import packed_fields, parses, shape, split_packed

PEOPLE = ["Ada Lovelace", "Alan Turing", "Grace Hopper", "Kurt Goedel", "Emmy Noether", "Paul Erdos"]


def test_shape():
    assert shape("P. W. Smith") == "A. A. X" and shape("cs.CL 12") == "x.C 9"


def test_parses_of_a_list():
    got = {n: v for n, v, _ in parses('["a, b", "c \\"d\\"", "e"]')}
    assert got["list"] == ["a, b", 'c "d"', "e"]
    assert {n: v for n, v, _ in parses("['x', 'y z']")}["list"] == ["x", "y z"]


@pytest.fixture(scope="module")
def split(spark):
    rows = []

    def add(*texts):
        for t in texts:
            rows.append((f"r{len(rows):03d}", "names", t, 0))

    for i in range(40):  # enough text for the values to be known
        a, b, c = (PEOPLE[(i + k) % 6] for k in (0, 1, 3))
        inverted = lambda n: ", ".join(reversed(n.split()))
        add(f"{a}, {b}, {c}", f"{a}; {b}", f"{inverted(a)}; {b}; {inverted(c)}", f'"{a}" | "{inverted(b)}"', f"{a}, {b} and {c}")
    first = len(rows)
    add("Ada Lovelace; Turing, Alan ;; Grace Hopper;", '["Ada Lovelace", "Turing, Alan"]', 'Ada Lovelace,"Turing, Alan",Ada Lovelace', "Ada Lovelace / Alan Turing and Grace Hopper", "Ada Lovelace\nAlan Turing", "Lovelace, Ada", " Ada Lovelace ", "", None, ";;")
    rows.append((None, "names", "x", 0))
    df = spark.createDataFrame(rows, "rec_id string, field string, text string, val int")
    got = {}
    for r in split_packed(df).orderBy("rec_id", "pos").collect():
        got.setdefault(r.rec_id, []).append((r.pos, r.val))
    assert all([p for p, _ in v] == list(range(1, len(v) + 1)) for v in got.values())
    return [[x for _, x in got.get(f"r{i:03d}", [])] for i in range(first, len(rows) - 1)]


@pytest.mark.parametrize("at,want", list(enumerate([
    ["Ada Lovelace", "Turing, Alan", "Grace Hopper"], ["Ada Lovelace", "Turing, Alan"], ["Ada Lovelace", "Turing, Alan", "Ada Lovelace"], ["Ada Lovelace", "Alan Turing", "Grace Hopper"],
    ["Ada Lovelace", "Alan Turing"], ["Lovelace, Ada"], ["Ada Lovelace"], [], [], [],
])))
def test_values(split, at, want):
    assert split[at] == want


def test_empty_and_latest(spark):
    assert split_packed(spark.createDataFrame([], "rec_id string, field string, text string")).count() == 0
    df = spark.createDataFrame([("a", "x; y", 1), ("a", "x; y; z", 2), (None, "q", 1)], "id string, f string, v int")
    assert [tuple(r) for r in packed_fields(df, "id", ["f"], "v").collect()] == [("a", "f", "x; y; z")]
