import random
import time
from datetime import datetime

import pytest

from papyra.llm.boosting import BoostedTrees
from papyra.llm.markup import ATTRIBUTE_TOKENS, _counts, _Index, clean, clean_markup, features, trained
from papyra.llm.markup_nodes import lines_around, tree
from papyra.llm.markup_samples import sample


@pytest.fixture(scope="module")
def model():
    return trained()


@pytest.mark.parametrize("text,want", [
    ("A <b>bold</b> word &amp; more.", "A bold word & more."),
    ("We use H<sub>2</sub>O here.", "We use H2O here."),
    ("See [the notes](https://notes.invalid/3) now.", "See the notes now."),
    ("Then **three of four** domains and `top_k=3` runs.", "Then three of four domains and top_k=3 runs."),
    ("The [[Topic:3|compact rankers]] and [[Graphs]] agree {{cite|id=5}}.", "The compact rankers and Graphs agree ."),
    ("It is \\textbf{not so} in Table~\\ref{tab:3} at 33\\% there.", "It is not so in Table  at 33% there."),
    ("The sum $\\sum_{q} m$ is small.", "The sum ⟦\\sum_{q} m⟧ is small."),
    ("## Related Work\n\nText follows here.", "§ Related Work\n\nText follows here."),
    ("== Data ==\nText follows here.", "§ Data\n\nText follows here."),
    ("Some text.\n\n- first point\n- second point", "Some text.\n\n• first point\n• second point"),
    ("Some text.\n```py\nx = 1\ny = 2\n```", "Some text.\n\n    x = 1\n    y = 2"),
    ("Text <!-- hidden 3 --> here.", "Text  here."),
])
def test_clean(model, text, want):
    out, n = clean(text, model)
    assert n["pieces"] > 0
    assert out == want


@pytest.mark.parametrize("text", [
    "We keep pairs with x<y and z>w in the test.", "Counts fall below <7426 ms and >6760 ms here.", "Annotators were paid $18 per hour for 42 and $20 per day.", "Set a = b^2 + c_1 only.", "The flag top_k and the file run_46_final are kept.",
    "Results are in [2172] and in run #1580.", "The loop was ported to C# and is 33 * 40 in size.", "An R&D team ranked it.", "Roughly ~8388 prompts.", "• first\n• second", "3.1 Methods\nText.", "[figure omitted]", "", "plain words",
])
def test_lookalikes_stay(model, text):
    out, n = clean(text, model)
    assert n["pieces"] == 0 and out == text


def test_nothing_inside_code_is_markup(model):
    out, n = clean("Run `a **b** <i>c</i>` now.", model)
    assert out == "Run a **b** <i>c</i> now." and n["code"] == 1


def test_held_out_accuracy(model):
    rng, right, total = random.Random(991), 0, 0
    for _ in range(600):
        text, spans = sample(rng)
        _, n = clean(text, model)
        right, total = right + (bool(n["pieces"]) == bool(spans)), total + 1
    assert right / total > 0.98


@pytest.mark.parametrize("text,want", [
    ("A \\frac{1}{2} share is kept here.", "A 1/2 share is kept here."), ("Set the \\alpha level first.", "Set the α level first."), ("Done.\n\\begin{tabular}{cc} a & b \\\\ c & d \\end{tabular}", "Done.\n\na\tb\nc\td"),
    ("See [the paper][1] now.\n\n[1]: https://x.invalid/y", "See the paper now."), ("Go to <https://x.invalid/a> now.", "Go to https://x.invalid/a now."), ("\\emph{a \\textbf{b \\texttt{c \\textsc{d}}}} e", "a b c d e"),
])
def test_more_forms(model, text, want):
    assert clean(text, model)[0] == want


@pytest.mark.parametrize("text", ["A List<String> of names.", "#include <vector>\nint x;", "Table notes.\n* significant at 5%", "A long line of text that goes on and on for a while.\n----\nMore follows."])
def test_more_lookalikes(model, text):
    assert clean(text, model)[0] == text


@pytest.mark.parametrize("text", ["\\begin{a}" * 110_000, "<!--" * 250_000, "**a " * 250_000, "$a " * 330_000, "# " * 500_000 + "b", "<a " * 330_000, "[a](b " * 160_000, "``a " * 250_000, "[http://a " * 100_000, "{{a|" * 250_000, "[[a|" * 250_000])
def test_marks_left_open_take_linear_time(text):
    began = time.time()
    tree(text)
    assert time.time() - began < 4  # far beyond what is needed; quadratic time would be minutes


def test_deep_nesting(model):
    out, n = clean("<b>" * 10_000 + "x" + "</b>" * 10_000, model)
    assert n["pieces"] in (0, 10_000) and "x" in out
    assert len(tree("\\a{" * 20_000 + "}" * 20_000)[1]) == 20_000


def test_boosting_learns_an_interaction():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.integers(0, 4, (2000, 3))
    y = ((x[:, 0] > 1) ^ (x[:, 1] > 1)).astype(float)
    z = BoostedTrees().fit(x[:1500], y[:1500]).log_odds(x[1500:])
    assert ((z > 0) == (y[1500:] > 0.5)).mean() > 0.98


def test_trees_nest():
    _, nodes = tree("<ul><li>a</li><li><b>c</b></li></ul>")
    assert [(n.name, n.depth) for n in nodes] == [("ul", 0), ("li", 1), ("li", 1), ("b", 2)]
    assert features("<ul><li>a</li></ul>", *tree("<ul><li>a</li></ul>")).shape == (2, 36 + ATTRIBUTE_TOKENS)


def test_fields(spark, frame):
    rows = [("papers", "a", "title", "x <i>y</i>", None, 1), ("papers", "a", "title", "x <i>y</i>", None, 1), ("papers", "b", "title", None, None, 1), ("papers", None, "title", "<b>x</b>", None, 1), ("papers", "c", "title", "x < y", None, 1), ("chunks", "l", "text", "w " * 100_000 + "<b>z</b>", None, 1)]
    got = {(r.tab, r.rec_id, r.field): r.clean_text for r in clean_markup(frame(rows, "tab string, rec_id string, field string, text string, ver timestamp, pieces int")).collect()}
    assert set(got) == {("papers", "a", "title"), ("chunks", "l", "text")} and got["papers", "a", "title"] == "x y" and got["chunks", "l", "text"].endswith("w z")
    assert clean_markup(frame([], "tab string, rec_id string, field string, text string, ver timestamp")).count() == 0


def test_a_newer_clean_delivery_leaves_nothing(frame):
    rows = [("papers", "a", "title", "x <i>y</i>", datetime(2024, 1, 1)), ("papers", "a", "title", "x y", datetime(2024, 2, 1)), ("papers", "b", "title", "x y", datetime(2024, 1, 1)), ("papers", "b", "title", "x <i>y</i>", datetime(2024, 2, 1))]
    got = clean_markup(frame(rows, "tab string, rec_id string, field string, text string, ver timestamp"))
    assert {r.rec_id for r in got.collect()} == {"b"}


def test_long_tex_quotes_are_undone_and_end_with_the_paragraph(model):
    said = "the ranker of " + "many lexical kernels and " * 30 + "nothing else"
    out, n = clean(f"They wrote ``{said}'' at the end.", model)
    assert n["pieces"] == 1 and "``" not in out and "''" not in out and said in out
    text = f"They wrote ``{said}\n\nanother paragraph'' here."
    assert all(x.kind != "tex quotes" for x in tree(text)[1])
    assert any(x.kind == "tex quotes" for x in tree(text.replace("\n\n", "\n"))[1])


@pytest.mark.parametrize("plain,other", [
    ("<div>" + "word " * 2000 + "</div>", "<div>" + "word " * 1000 + "7 =\n" * 500 + "word " * 1000 + "</div>"),
    ("<div>" + "<b>c</b>" * 50 + "w" * 3000 + "</div>", "<div>" + "<b>c</b>" * 50 + "<b>" + "w" * 2993 + "</b></div>"),
    ("<p a='" + "v" * 600 + "'>w", "<p a='" + "v" * 600 + "' b\"c>w"),
    ("<p a='" + "v" * 600 + "'>w", "<p a='" + "v" * 600 + "' href='x'>w"),
])
def test_features_look_at_all_of_a_long_content(plain, other):
    assert tuple(features(plain, *tree(plain))[0]) != tuple(features(other, *tree(other))[0])


def test_lines_around_are_whole():
    text = "- w" + " word" * 100 + "\n- one\n" + "word " * 100 + "end\nw"
    n = next(n for n in tree(text)[1] if text[n.start : n.end] == "- one")
    assert lines_around(text, n) == ("- w" + " word" * 100, "word " * 100 + "end")


def test_counts_of_long_contents_are_those_of_their_text():
    r = random.Random(6)
    for _ in range(400):
        text = "".join(r.choice(["the", "them", "of", "x", "a", "=", "<", "\n", " ", "  ", "7", "²", "_", "é", "ſ", "is"]) for _ in range(r.randint(0, 50)))
        index = _Index(text)
        for _ in range(10):
            a = r.randint(0, len(text))
            b = r.randint(a, len(text))
            assert index.counts(a, b) == _counts(text[a:b])
