"""Query understanding as columns: analyzer output, keyword queries, sections, model names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import INTENT_CUES, STOP_WORDS, SYNONYMS, alpha_ratio, keyword_tokens, strip, words_of

# ---- fixed values: the analyzer's fields and enumerations ----------------------------------------------------------
ANALYSIS = (
    "intent string, keyword_query string, semantic_query string, content string, authors array<string>, venues array<string>, recency string, centrality string,"
    " broad_or_specific string, qualifiers array<string>, time_range struct<start:int,end:int>, domains struct<main:string,other:array<string>>,"
    " metadata_filters struct<year_min:int,year_max:int,venue:string,author:string,field_of_study:string>"
)
INTENTS = ["find_papers", "find_specific_paper", "find_author"]
QUALIFIERS = ["recent", "popular", "classic", "central"]
#: scores of a document's section titles and model names, and of terms that an intent suggests
SECTION_SCORE, MODEL_SCORE, INTENT_SCORE = 2.4, 2.2, 2.0
CLAUSE = r'((?:[+-]\s*)?(?:"[^"]*"?|[^\s"]\S*))'
# -------------------------------------------------------------------------------------------------------------------


def _blank(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def parse_analysis(raw: Column, question: Column) -> Column:
    """struct(intent, keyword_query, semantic_query, year_min, year_max, author, venue, field_of_study, qualifiers) of a model's
    JSON answer. Values outside the known ones fall to their defaults; what the answer lacks comes from its content, else from
    the question. Malformed JSON gives the defaults."""
    j = F.from_json(raw, ANALYSIS)
    m = j["metadata_filters"]
    content, asked = _blank(j["content"]), strip(question)
    given = F.coalesce(j["qualifiers"], F.array().cast("array<string>"))
    more = F.array_compact(F.array(F.when(j["recency"] == "recent", F.lit("recent")), F.when(j["recency"] == "early", F.lit("classic")), F.when(j["centrality"] == "first", F.lit("central"))))
    names = lambda c: F.nullif(F.array_join(F.filter(c, lambda x: strip(x) != ""), ", "), F.lit(""))
    return F.struct(
        F.when(j["broad_or_specific"] == "specific", "find_specific_paper").when(j["intent"].isin(INTENTS), j["intent"]).otherwise("find_papers").alias("intent"),
        F.coalesce(_blank(j["keyword_query"]), content, asked).alias("keyword_query"),
        F.coalesce(_blank(j["semantic_query"]), content, asked).alias("semantic_query"),
        F.coalesce(j["time_range"]["start"], m["year_min"]).alias("year_min"),
        F.coalesce(j["time_range"]["end"], m["year_max"]).alias("year_max"),
        F.coalesce(names(j["authors"]), m["author"]).alias("author"),
        F.coalesce(names(j["venues"]), m["venue"]).alias("venue"),
        F.lower(strip(F.coalesce(m["field_of_study"], j["domains"]["main"]))).alias("field_of_study"),
        F.array_distinct(F.concat(F.filter(given, lambda q: q.isin(QUALIFIERS)), more)).alias("qualifiers"),
    )


def entity_spans(question: Column) -> Column:
    """Runs of two or more capitalised words."""
    return F.array_distinct(F.regexp_extract_all(question, F.lit(r"\b([A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+)+)"), 1))


def raw_terms(question: Column) -> Column:
    """The question's terms in order, each once: entity spans whole, between them single words outside stop words."""
    span = r"\b[A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+)+"
    pieces = F.regexp_extract_all(question, F.lit(rf"({span}|[A-Za-z0-9][A-Za-z0-9\-]+)"), 1)
    terms = F.transform(pieces, lambda x: F.when(x.rlike(r"\s"), x).otherwise(F.lower(x)))
    return F.array_distinct(F.filter(terms, lambda w: ~w.isin(STOP_WORDS)))


def parsed_query_string(raw: Column) -> Column:
    """Clauses array<struct<text, is_phrase, must>> of a query in which ``+`` marks a term that must match, ``-`` an optional
    one, and quotes a phrase. Blank clauses are left out."""
    pieces = F.regexp_extract_all(raw, F.lit(CLAUSE), 1)
    body = lambda x: F.regexp_replace(x, r"^[+-]\s*", "")
    quoted = lambda x: body(x).startswith('"')
    text = lambda x: strip(F.when(quoted(x), F.regexp_replace(body(x), r'^"|"$', "")).otherwise(body(x)))
    clauses = F.transform(pieces, lambda x: F.struct(text(x).alias("text"), quoted(x).alias("is_phrase"), x.startswith("+").alias("must")))
    return F.filter(clauses, lambda c: c["text"] != "")


def query_clauses(boosted: Column, normal: Column) -> Column:
    """Clauses of a keyword query, in order: boosted terms must match, normal ones may; each (term, must) once, whatever its
    case; terms of several words are phrases."""
    def of(terms: Column, must: bool) -> Column:
        known = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), strip), lambda t: t != "")
        low = F.transform(known, F.lower)
        first = F.filter(known, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
        return F.transform(first, lambda t: F.struct(t.alias("text"), t.rlike(r"\s").alias("is_phrase"), F.lit(must).alias("must")))

    return F.concat(of(boosted, True), of(normal, False))


def query_text(boosted: Column, normal: Column) -> Column:
    """The normal terms, else the boosted ones, joined by blanks; "keyword" if there is none."""
    joined = lambda c: F.nullif(F.array_join(F.filter(F.transform(c, strip), lambda t: t != ""), " "), F.lit(""))
    return F.coalesce(joined(normal), joined(boosted), F.lit("keyword"))


def analyzer_terms(keyword_query: Column, boosted: Column, regular: Column, question: Column) -> Column:
    """The terms of one query: the analyzer's keywords, else its boosted and regular ones, else the question's; each once."""
    some = lambda c: F.filter(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))), lambda t: t != "")
    a, b = some(keyword_query), some(F.concat(F.coalesce(boosted, F.array().cast("array<string>")), F.coalesce(regular, F.array().cast("array<string>"))))
    return F.when(F.size(a) > 0, a).when(F.size(b) > 0, b).otherwise(F.array_distinct(keyword_tokens(question)))


def search_text(generated: Column, question: Column) -> Column:
    """A generated text (simulated answer, hypothetical abstract, rewrite) in place of the question, unless it is blank."""
    return F.coalesce(_blank(generated), strip(question))


def scored_candidates(questions: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(qid, term, score, sources)``: candidate terms of ``questions(qid, text)`` with those of their documents' anchors.

    Phrases between stop words of at most five tokens and 96 characters, mostly letters, score the sum of their words' degrees
    plus frequencies over frequency, counted in the question, and more for several words, capitals, digits and an early place. A phrase
    of several words counts only if all are capitalised or one holds a digit. Terms of ``anchors(qid, section_titles,
    model_names)`` and of the question's intent have fixed scores; a term found several times keeps its best."""
    word = r"[A-Za-z0-9][A-Za-z0-9\-]+"
    pieces, gaps = F.regexp_extract_all("text", F.lit(f"({word})"), 1), F.transform(F.split("text", word), F.length)
    zipped = F.arrays_zip(pieces.alias("surface"), F.slice(gaps, 1, F.size(pieces)).alias("gap"))
    t = questions.where("text is not null").select("qid", F.posexplode(zipped).alias("pos", "x")).select("qid", "pos", "x.surface", "x.gap")
    t = t.withColumn("lemma", F.lower("surface"))
    own = Window.partitionBy("qid").orderBy("pos")
    t = t.withColumn("start", F.sum(F.col("gap") + F.length("surface")).over(own) - F.length("surface"))
    t = t.withColumn("stop", F.col("lemma").isin(STOP_WORDS)).withColumn("grp", F.sum(F.col("stop").cast("int")).over(own)).where("not stop")
    t = t.withColumn("len", F.count("*").over(Window.partitionBy("qid", "grp")))
    same = Window.partitionBy("qid", "lemma")
    t = t.withColumn("ws", (F.sum(F.col("len") - 1).over(same) + F.count("*").over(same)) / F.count("*").over(same))
    upper, digit = F.col("surface").rlike("^[A-Z]"), F.col("surface").rlike("[0-9]")
    p = t.groupBy("qid", "grp", "len").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "surface"))), lambda x: x["surface"]), " ").alias("term"), F.min("start").alias("start"), F.sum("ws").alias("base"),
        F.bool_and(upper).alias("caps"), F.bool_or(digit).alias("digit"), F.bool_or(F.length("lemma") >= 3).alias("long"), F.bool_or(F.col("surface").rlike("^[A-Z0-9\\-]*[A-Z][A-Z0-9\\-]*$")).alias("acronym"),
    )
    several = (F.col("len") == 1) | F.col("caps") | F.col("digit")
    p = p.where((F.col("len") <= 5) & (F.length("term") <= 96) & (alpha_ratio(F.col("term")) >= 0.35) & several & (F.col("long") | ((F.col("len") > 1) & F.col("caps")) | F.col("acronym") | F.col("digit")))
    more = F.when(F.col("len") > 1, 0.3).otherwise(0.0) + F.when(F.col("caps"), 0.4).otherwise(0.0) + F.when(F.col("digit"), 0.2).otherwise(0.0) + F.greatest(F.lit(0.0), 0.4 - F.col("start") * 0.01)
    own_terms = p.select("qid", "term", (F.col("base") + more).alias("score"), F.lit("rake").alias("source"))
    listed = lambda c, score, name: anchors.select("qid", F.explode(F.array_distinct(F.filter(F.transform(c, strip), lambda x: x != ""))).alias("term"), F.lit(score).alias("score"), F.lit(name).alias("source"))
    cues = F.create_map(*[x for k, v in INTENT_CUES.items() for x in (F.lit(k), words_of(v))])
    hit = F.filter(F.map_keys(cues), lambda k: F.contains(F.lower(F.col("text")), k))
    intent = questions.select("qid", F.explode(F.flatten(F.transform(hit, lambda k: F.element_at(cues, k)))).alias("term"), F.lit(INTENT_SCORE).alias("score"), F.lit("intent").alias("source"))
    every = own_terms.unionByName(listed("section_titles", SECTION_SCORE, "section")).unionByName(listed("model_names", MODEL_SCORE, "model")).unionByName(intent)
    return every.groupBy("qid", F.lower("term").alias("term")).agg(F.round(F.max("score"), 6).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def section_score(question: Column, title: Column, priority: Column | None = None) -> Column:
    """How well a section title suits a question: shared words, their share of the title, short titles and capitals a little more."""
    a, b = F.array_distinct(keyword_tokens(question)), F.array_distinct(keyword_tokens(title))
    both = F.size(F.array_intersect(a, b))
    score = both + F.when(F.size(b) > 0, both / F.size(b)).otherwise(0.0) + F.when(title.rlike(r"^[A-Z]"), 0.2).otherwise(0.0) + F.when(F.size(b) <= 4, 0.05).otherwise(0.0)
    return score if priority is None else score + F.when(priority, 0.8).otherwise(0.0)


def model_pick(question: Column, names: Column) -> Column:
    """The first model name that isn't blank, if the question speaks of a model."""
    return F.when(F.lower(question).contains("model"), F.get(F.filter(names, lambda n: strip(n) != ""), F.lit(0)))


def synonyms(terms: Column, most: int = 3) -> Column:
    known = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), words_of(v))])
    return F.flatten(F.transform(F.filter(terms, lambda t: F.map_contains_key(known, F.lower(t))), lambda t: F.slice(F.element_at(known, F.lower(t)), 1, most)))


def keyword_queries(questions: DataFrame) -> DataFrame:
    """``(qid, number, boosted, normal, section)`` from ``questions(qid, text, ranked, sections)``: five queries a question.

    Number 0 is the raw terms; 1 and 2 boost two terms each and add up to four; 3 and 4 boost one, add up to three and their
    synonyms, and are bound to the first and second section. ``ranked``: the question's terms, best first."""
    cues = F.create_map(*[x for k, v in INTENT_CUES.items() for x in (F.lit(k), words_of(v))])
    intent = F.flatten(F.transform(F.filter(F.map_keys(cues), lambda k: F.contains(F.lower(F.col("text")), k)), lambda k: F.element_at(cues, k)))
    q = questions.select("qid", raw_terms(F.col("text")).alias("raw"), F.coalesce("ranked", F.array()).alias("ranked"), F.coalesce("sections", F.array()).alias("sections"), entity_spans(F.col("text")).alias("spans"), intent.alias("intent"))
    blocked = F.transform("sections", F.lower)
    q = q.withColumn("pool", F.filter(F.array_distinct(F.concat("spans", "ranked", "intent")), lambda t: ~F.array_contains(blocked, F.lower(t))))

    def one(number: int, boosted: Column, normal: Column, section: Column) -> Column:
        return F.struct(F.lit(number).alias("number"), boosted.alias("boosted"), normal.alias("normal"), section.alias("section"))

    none, no_section = F.array().cast("array<string>"), F.lit(None).cast("string")
    rest = lambda b, n: F.slice(F.array_except(F.array_distinct(F.concat("ranked", "raw")), b), 1, n)
    out = [one(0, none, F.col("raw"), no_section)]
    for i in (0, 1):
        b = F.slice("pool", 1 + 2 * i, 2)
        out.append(one(1 + i, b, rest(b, 4), no_section))
    for i in (0, 1):
        b = F.slice("pool", 1 + i, 1)
        n = rest(b, 3)
        out.append(one(3 + i, b, F.array_distinct(F.concat(n, synonyms(n))), F.get("sections", F.lit(i))))
    return q.select("qid", F.explode(F.array(*out)).alias("x")).select("qid", "x.*")
