"""Text functions against what they must give on small inputs."""

import pytest
from pyspark.sql import functions as F

from papyra.functions import records as R
from papyra.functions import text as T


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items()))
    return df.select(expression.alias("x")).first().x


@pytest.mark.parametrize("word,want", [("training", "trai"), ("used", "used"), ("studies", "study"), ("classes", "class"), ("ties", "tie"), ("largest", "larg"), ("class", "class"), ("cats", "cat"), ("quickly", "quick"), ("a", "a")])
def test_lemma(spark, word, want):
    assert one(spark, T.lemma(F.col("w")), w=word) == want


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t=" One. Two!  Three?\nFour ") == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, T.closed_sentences(F.col("t")), t="value 3.14 is ok. Next one.") == ["14 is ok.", "Next one."]
    assert one(spark, T.sentences(F.col("t")), t=None) is None
    assert one(spark, T.sentences(F.col("t")), t="") == []


@pytest.mark.parametrize("line,want", [("3.1 Methods", True), ("RESULTS", True), ("ends here.", False), ("Related Work", True), ("lower case words", False), ("", False)])
def test_heading(spark, line, want):
    assert one(spark, T.heading(F.col("t")), t=line) is want


def test_heading_level(spark):
    assert one(spark, T.heading_level(F.col("t")), t="3.1.2 Data") == 3
    assert one(spark, T.heading_level(F.col("t")), t="Data") == 1


def test_model_names_need_a_prefix(spark):
    assert one(spark, T.model_names(F.col("t")), t="We use GraphNet and BERT, GraphNet again.") == ["GraphNet"]


@pytest.mark.parametrize("title,want", [("References", 0.15), ("Methods", 1.15), ("Appendix", 1.0)])
def test_section_bias(spark, title, want):
    assert one(spark, T.section_bias(F.col("t"), F.lit(None).cast("string")), t=title) == want


@pytest.mark.parametrize("text,want", [("1. foo, bar", "INCOMPLETE"), ("Done.", "COMPLETE"), ("these", "INCOMPLETE"), ("and so on.", "PARTIAL"), ("  ", "INCOMPLETE")])
def test_completeness(spark, text, want):
    assert one(spark, T.completeness(F.col("t")), t=text) == want


def test_keyword_list(spark):
    assert one(spark, T.keyword_list(F.col("t")), t='["a b", " c ", ""]') == ["a b", "c"]
    assert one(spark, T.keyword_list(F.col("t")), t="a, b;c|d\n ,") == ["a", "b", "c", "d"]
    assert one(spark, T.keyword_list(F.col("t")), t="[broken") == ["[broken"]


def test_stop_words_keep_a_text_of_nothing_else(spark):
    assert one(spark, T.strip_stop_words(F.col("t")), t="the of and") == "the of and"
    assert one(spark, T.strip_stop_words(F.col("t")), t="The cat on the mat") == "cat mat"


def test_jaccard_and_occurrences(spark):
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=[], b=["y"]) == 0
    assert one(spark, T.occurrences(F.col("t"), F.lit("rag")), t="RAG is in fragment") == 2


def test_shingles(spark):
    assert one(spark, T.shingles(F.col("a"), 2), a=["x", "y", "z"]) == ["x y", "y z"]
    assert one(spark, T.shingles(F.col("a"), 3), a=["x"]) == []


def test_list_prefix_and_spans(spark):
    assert one(spark, T.list_prefix_stripped(F.col("t")), t="12) - a line") == "a line"
    assert one(spark, T.span_normalised(F.col("t")), t="1 2 3 4 5 6 7 8 9") is None
    assert len(one(spark, T.span_normalised(F.col("t")), t="word " * 20)) <= 64


def test_records(spark):
    assert one(spark, R.first_non_empty(F.col("a"), F.col("b")), a="  ", b=" x ") == "x"
    assert one(spark, R.embedding_text(F.col("a"), F.col("b")), a="t", b=None) == "t [SEP] "
    assert one(spark, R.embedding_text(F.col("a"), F.col("b")), a=" ", b=None) == ""
    assert one(spark, R.date_part(F.col("a")), a="2020-01-02T03:04") == "2020-01-02"
    assert one(spark, R.year(F.col("a"), F.col("b")), a="n.d.", b="May 1999") == 1999
    assert one(spark, R.trimmed(F.col("a"), 3), a="abcd") == "abc…"


def test_authors(spark):
    df = spark.sql("select named_struct('name', null, 'full_name', '', 'first', 'A', 'middle', null, 'last', 'B', 'suffix', ' ') a")
    assert df.select(R.author_name(F.col("a"))).first()[0] == "A B"
    df = spark.sql("select array(array('B', 'A', ''), array(''), array('C')) p")
    assert df.select(R.authors_from_parts(F.col("p"))).first()[0] == "B A, C"


@pytest.mark.parametrize("categories,want", [("cs.CL cs.LG", True), (" cs.IR", True), ("math.CO", False), ("cs.CLX", False), (None, False)])
def test_category_filter(spark, categories, want):
    assert one(spark, R.in_categories(F.col("c"), ["cs.CL", "cs.IR"]), c=categories) is want


def test_unknown_year_fails_a_bound(spark):
    df = spark.createDataFrame([(2019,), (None,), (2024,)], "y int")
    assert [r.y for r in df.where(R.year_between(F.col("y"), 2020, None)).collect()] == [2024]
    assert df.where(R.year_between(F.col("y"), None, None)).count() == 3
