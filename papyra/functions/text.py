"""Text functions: Column in, Column out, evaluated in the JVM (but for ``token_spans`` and ``window_spans``).

Patterns use ASCII classes, so that they mean the same to every SQL engine.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

_TOKEN = re.compile(r"\S+", re.ASCII)

# ---- fixed values -------------------------------------------------------------------------------------------------
#: short list of function words used where no larger one is configured
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "for", "to", "in", "on", "with", "at", "by", "from", "that", "this", "these", "those", "is", "are"]
SECTION_PENALTIES = ["reference", "references", "bibliography", "acknowledgment", "acknowledgement", "supplement", "supplementary"]
SECTION_BONUSES = ["abstract", "introduction", "background", "method", "methods", "approach", "model", "experiment", "results", "finding", "analysis", "discussion"]
MODEL_NAME = r"\b([A-Z][A-Za-z0-9]*(?:Net|Former|BERT|GPT|GAN|LM|Transformer|Model|Network|System))\b"
NUMBERED_HEADING = r"^(?:[0-9]+(?:\.[0-9]+)*)\s+[^\d]+"
HEADING_NUMBER = r"^([0-9]+(?:\.[0-9]+)*)\s"
ENUMERATOR = r"(?:^|\n)\s*(?:[\-•\*]|[0-9]+[.)])"
SENTENCE_BREAK = r"(?<=[.!?])\s+"
CLOSED_SENTENCE = r"([^.!?]+[.!?]+)(?=\s|$)"
KEYWORD_BREAK = r"[\n,;|]+"
LIST_PREFIX = r"^\d+[).\s-]*"
QUESTION_TOKEN = r"([A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*)"
#: function words an English index leaves out
ENGLISH_STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]
#: words that aren't keywords of their own
KEYWORD_STOP_WORDS = ["a", "an", "the", "of", "and", "or", "in", "on", "for", "to", "from", "by", "with", "at"]
DEFAULT_SECTIONS = ["Introduction", "Method", "Results"]
INTENT_CUES = {
    "architecture": ["architecture", "framework"],
    "framework": ["framework", "design"],
    "pipeline": ["pipeline", "workflow"],
    "method": ["method", "approach"],
    "approach": ["approach", "strategy"],
    "compare": ["comparison", "baseline"],
    "evaluation": ["evaluation", "metrics"],
    "ablation": ["ablation", "analysis"],
    "result": ["result", "finding"],
}
SYNONYMS = {"retrieval": ["search"], "qa": ["question answering", "q&a"], "method": ["approach"], "result": ["finding"], "experiment": ["study"]}
# -------------------------------------------------------------------------------------------------------------------


def words_of(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Runs of non-white-space."""
    return F.regexp_extract_all(c, F.lit(r"(\S+)"), 1)


def keyword_tokens(c: Column) -> Column:
    """Words of letters, digits and hyphens, two characters or more, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9][a-z0-9\-]+)"), 1)


def plain_terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), 1)


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def lemma_plural(w: Column) -> Column:
    """Light lemma of a lower-case word, plural endings only: -ies (over 4 letters) becomes -y, -ses (over 4) loses two letters,
    and -s (over 3, not -ss) one."""
    n = F.length(w)
    return (
        F.when((n > 4) & w.endswith("ies"), F.concat(_cut(w, 3), F.lit("y")))
        .when((n > 4) & w.endswith("ses"), _cut(w, 2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), _cut(w, 1))
        .otherwise(w)
    )


def lemma(w: Column) -> Column:
    """Fuller lemma of a lower-case word: after -ies and -ses, -ing (over 5 letters) takes four letters with it, -ed (over 4)
    three, -ly and -er (over 4) two, -est (over 5) three, and -s as in ``lemma_plural``."""
    n = F.length(w)
    return (
        F.when((n > 4) & (w.endswith("ies") | w.endswith("ses")), lemma_plural(w))
        .when((n > 5) & w.endswith("ing"), _cut(w, 4))
        .when((n > 4) & w.endswith("ed"), _cut(w, 3))
        .when((n > 4) & (w.endswith("ly") | w.endswith("er")), _cut(w, 2))
        .when((n > 5) & w.endswith("est"), _cut(w, 3))
        .otherwise(lemma_plural(w))
    )


def analyzed(c: Column) -> Column:
    """Terms as an English index holds them: runs of letters and digits in lower case, without stop words, plural endings cut.

    Null for null; stop words are compared before the ending is cut."""
    kept = F.filter(plain_terms(c), lambda w: ~w.isin(ENGLISH_STOP_WORDS))
    return F.transform(kept, lemma_plural)


def normalised_terms(c: Column, lemmatised: bool = True) -> Column:
    """Keyword tokens of a text, each in its fuller lemma, or in lower case only."""
    words = keyword_tokens(c)
    return F.transform(words, lemma) if lemmatised else words


def question_tokens(c: Column) -> Column:
    """Words in lower case, with apostrophes and hyphens inside them."""
    return F.regexp_extract_all(F.lower(c), F.lit(QUESTION_TOKEN), 1)


def token_clean(c: Column, most_chars: int = 64, least_alpha: float = 0.35) -> Column:
    """The token without white space and punctuation at both ends; null if it is blank, too long, or has neither letters enough
    nor a digit."""
    s = F.regexp_replace(c, r"""^[\s"'.,:;()\[\]{}]+|[\s"'.,:;()\[\]{}]+$""", "")
    return F.when((s != "") & (F.length(s) <= most_chars) & ((alpha_ratio(s) >= least_alpha) | s.rlike("[0-9]")), s)


def kept_sections(titles: Column, question: Column) -> Column:
    """Section titles without blank ones, and without reference lists unless the question speaks of references or citations."""
    asked = F.lower(question).rlike(r"\breferenc|\bcitation")
    low = lambda h: F.lower(h)
    return F.filter(titles, lambda h: (h != "") & (F.coalesce(asked, F.lit(False)) | ~(low(h).contains("reference") | low(h).contains("bibliography"))))


def section_defaults(titles: Column) -> Column:
    """The titles that aren't blank, or the default sections if there is none."""
    have = F.filter(F.coalesce(titles, F.array().cast("array<string>")), lambda h: strip(h) != "")
    return F.when(F.size(have) > 0, have).otherwise(words_of(DEFAULT_SECTIONS))


def anchors_mined(c: Column, most: int = 10) -> Column:
    """struct(section_titles, model_names) of a raw text, in order, each once, at most so many: lines that start with a capital,
    without a final colon, and model names."""
    lines = F.transform(F.split(c, r"\R"), strip)
    titles = F.transform(F.filter(lines, lambda x: x.rlike(r"^\p{Lu}")), lambda x: F.regexp_replace(x, ":+$", ""))
    return F.struct(F.slice(F.array_distinct(titles), 1, most).alias("section_titles"), F.slice(model_names(c), 1, most).alias("model_names"))


def term_overlap(sentence: Column, wanted: Column) -> Column:
    """The share of the wanted terms (lemmas) that the sentence holds; 0 if there are none."""
    have = F.array_distinct(normalised_terms(sentence))
    need = F.array_distinct(F.filter(wanted, lambda x: x != ""))
    return F.when(F.size(need) > 0, F.size(F.array_intersect(have, need)) / F.size(need)).otherwise(F.lit(0.0))


def question_line(c: Column) -> Column:
    """A generator's answer as one question: what follows "Question:", its first line, ended by a question mark; ``INVALID`` if
    there is none or the generator says so."""
    s = strip(F.coalesce(c, F.lit("")))
    s = strip(F.regexp_replace(s, r"(?s)^.*?Question:", ""))
    line = strip(F.regexp_extract(s, r"^([^\r\n]*)", 1))
    asked = F.when(line.endswith("?"), line).otherwise(F.concat(F.regexp_replace(line, r"[. ]+$", ""), F.lit("?")))
    return F.when((line == "") | F.upper(line).startswith("INVALID"), F.lit("INVALID")).otherwise(asked)


@F.pandas_udf(t.ArrayType(t.StructType([t.StructField("token", t.StringType()), t.StructField("start", t.IntegerType()), t.StructField("end", t.IntegerType())])))
def token_spans(c: pd.Series) -> pd.Series:
    """Runs of non-white-space with where they stand, ends exclusive. Null for null."""
    one = lambda x: None if x is None else [{"token": m.group(), "start": m.start(), "end": m.end()} for m in _TOKEN.finditer(x)]
    return c.map(one)


def window_spans(c: Column, size: int, overlap: int, least: int) -> Column:
    """array<struct<start, end, tokens>>: where each window of ``size`` tokens starts and ends and how many it has, as
    ``chunking.token_windows`` cuts them. Null for null.

    Only the windows leave the worker, and no text's tokens are kept beside another's."""
    step = size - overlap

    def one(x: str | None) -> list[dict] | None:
        if x is None:
            return None
        at = [m.span() for m in _TOKEN.finditer(x)]
        n = len(at)
        if not n:
            return []
        last = max(0, -(-(n - size) // step))
        # the last window is left out where it is too short
        last -= last > 0 and n - last * step < least
        return [{"start": at[k * step][0], "end": at[min(k * step + size, n) - 1][1], "tokens": min(size, n - k * step)} for k in range(last + 1)]

    @F.pandas_udf("array<struct<start:int,end:int,tokens:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return spans(c)


def strip_stop_words(c: Column) -> Column:
    """The text's words other than stop words, or the text itself if none is left."""
    kept = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9']+)"), 1), lambda w: ~w.isin(STOP_WORDS))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), c)


def sentences(c: Column) -> Column:
    """Pieces ending in . ! or ? before white space, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(c, SENTENCE_BREAK), strip), lambda s: s != "")


def closed_sentences(c: Column) -> Column:
    """Stretches without . ! ? up to a closing run of them that white space or the end follows, and the unclosed rest.

    Text before a point within a number is lost: only what stands after it belongs to the stretch."""
    closed = F.transform(F.regexp_extract_all(c, F.lit(CLOSED_SENTENCE), 1), strip)
    rest = strip(F.regexp_extract(c, r"([^.!?]*)$", 1))
    return F.filter(F.concat(closed, F.array(rest)), lambda s: s != "")


def alpha_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.length(c)).otherwise(F.lit(0.0))


def informative(c: Column) -> Column:
    """Long enough, not shouted, mostly letters, at least four different words."""
    s = strip(c)
    shouted = (F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) > 15)
    return (F.length(s) >= 12) & ~shouted & (alpha_ratio(s) >= 0.4) & (F.size(F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"(\w+)"), 1))) >= 4)


def numbered_heading(line: Column) -> Column:
    return line.rlike(NUMBERED_HEADING)


def heading(line: Column) -> Column:
    """A line of at most 120 characters without a final point: numbered, mostly capitals, or every word capitalised."""
    s = strip(line)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(s, r"[^\p{Lu}]", "")) / F.greatest(F.lit(1), letters)
    titled = s.rlike(r"\p{L}") & ~s.rlike(r"(?<![\p{L}])\p{Ll}|(?<=\p{L})\p{Lu}")
    return (s != "") & (F.length(s) <= 120) & ~s.endswith(".") & (numbered_heading(s) | (upper > 0.6) | titled)


def heading_level(line: Column) -> Column:
    number = F.regexp_extract(line, HEADING_NUMBER, 1)
    return F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).otherwise(F.lit(1))


def model_names(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(MODEL_NAME), 1))


def occurrences(c: Column, term: Column) -> Column:
    """How often ``term`` occurs in the text as a string, overlaps not counted."""
    t = F.lower(term)
    return F.when(F.length(t) > 0, ((F.length(c) - F.length(F.replace(F.lower(c), t, F.lit("")))) / F.length(t)).cast("int")).otherwise(F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def completeness(c: Column) -> Column:
    """COMPLETE, PARTIAL or INCOMPLETE, from four signs of a cut-off passage."""
    s = strip(c)
    low = F.lower(s)
    last = F.regexp_extract(low, r"(\S+)$", 1)
    signs = [
        s.rlike(ENUMERATOR),
        s.rlike(r"^\p{Ll}"),
        ~s.rlike(r"[.?!]$"),
        low.contains("as above") | last.isin("these", "those", "following"),
    ]
    n = sum(((x.cast("int")) for x in signs[1:]), signs[0].cast("int"))
    return F.when((s == "") | (n >= 2), "INCOMPLETE").when(n == 1, "PARTIAL").otherwise("COMPLETE")


def section_bias(title: Column, headings: Column, is_reference: Column | None = None) -> Column:
    """0.05 for reference lists, 0.15 for back matter, 1.15 for body sections, else 1."""
    low = F.lower(F.concat_ws(" ", title, headings))
    out = F.when(low.rlike("|".join(SECTION_PENALTIES)), 0.15).when(low.rlike("|".join(SECTION_BONUSES)), 1.15).otherwise(1.0)
    return out if is_reference is None else F.when(is_reference, 0.05).otherwise(out)


def keyword_list(c: Column) -> Column:
    """Keywords of a JSON list, or of a text split at line breaks, commas, semicolons and bars; blank ones left out."""
    s = strip(c)
    listed = F.from_json(s, "array<string>")
    parts = F.when(s.startswith("[") & s.endswith("]"), F.coalesce(listed, F.split(s, KEYWORD_BREAK))).otherwise(F.split(s, KEYWORD_BREAK))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def single_words(keywords: Column) -> Column:
    """Keywords cut into single words of letters and digits, in order, small words left out."""
    parts = F.flatten(F.transform(F.filter(keywords, lambda k: k.isNotNull()), lambda k: F.split(k, r"[^A-Za-z0-9]+")))
    return F.filter(parts, lambda w: (w != "") & ~F.lower(w).isin(KEYWORD_STOP_WORDS))


def span_normalised(c: Column, most_tokens: int = 8, most_chars: int = 64, least_alpha: float = 0.35) -> Column:
    """The first tokens, cut at a blank to the length allowed; null if too few letters."""
    s = F.array_join(F.slice(tokens(c), 1, most_tokens), " ")
    cut = F.regexp_replace(F.substring(s, 1, most_chars + 1), r"\s+\S*$", "")
    s = F.when(F.length(s) > most_chars, F.substring(cut, 1, most_chars)).otherwise(s)
    return F.when((s != "") & (alpha_ratio(s) >= least_alpha), s)


def list_prefix_stripped(c: Column) -> Column:
    return strip(F.regexp_replace(c, LIST_PREFIX, ""))


def shingles(terms: Column, n: int) -> Column:
    """Runs of ``n`` terms, joined by blanks."""
    out = terms
    for i in range(1, n):
        out = F.zip_with(out, F.slice(terms, i + 1, F.greatest(F.lit(1), F.size(terms))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda x: x.isNotNull())
