"""Projections of paper records: first value present, authors, dates, years, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import strip


def first_non_empty(*columns: Column) -> Column:
    """First value that isn't blank, stripped; null if all are."""
    return F.coalesce(*[F.nullif(strip(c.cast("string")), F.lit("")) for c in columns])


def embedding_text(title: Column, abstract: Column, separator: str = " [SEP] ") -> Column:
    """Title, separator, abstract; empty only if both are blank (the separator stays if one is)."""
    t, a = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(abstract, F.lit("")))
    return F.when((t == "") & (a == ""), F.lit("")).otherwise(F.concat(t, F.lit(separator), a))


def authors_from_parts(parts: Column) -> Column:
    """Authors given as arrays of name parts, each joined by blanks, all joined by commas; null if none."""
    one = F.transform(parts, lambda p: strip(F.array_join(F.filter(p, lambda x: strip(x) != ""), " ")))
    return F.nullif(F.array_join(F.filter(one, lambda x: x != ""), ", "), F.lit(""))


def format_authors(authors: Column) -> Column:
    """Structs as ``author_name`` takes, joined by commas; blank ones left out, null if none is left."""
    return F.nullif(F.array_join(F.filter(F.transform(authors, author_name), lambda x: x.isNotNull()), ", "), F.lit(""))


def author_name(author: Column) -> Column:
    """A struct's name, else full_name, else first, middle, last and suffix joined; null if blank."""
    joined = F.concat_ws(" ", *[F.nullif(strip(author[k]), F.lit("")) for k in ("first", "middle", "last", "suffix")])
    return first_non_empty(author["name"], author["full_name"], joined)


def date_part(c: Column) -> Column:
    """What stands before a T in a timestamp written out; null if blank."""
    return F.nullif(F.substring_index(strip(c), "T", 1), F.lit(""))


def first_date(dates: Column) -> Column:
    """Of a list of dates the first that isn't blank, cut as ``date_part`` does."""
    return F.get(F.filter(F.transform(dates, date_part), lambda x: x.isNotNull()), F.lit(0))


def year(*columns: Column) -> Column:
    """First 19xx or 20xx found, trying the columns in order."""
    found = [F.nullif(F.regexp_extract(c.cast("string"), r"((?:19|20)\d{2})", 1), F.lit("")) for c in columns]
    return F.coalesce(*found).cast("int")


def year_between(y: Column, low: int | None, high: int | None) -> Column:
    """Whether the year lies in the bounds; an unknown year fails any bound."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & F.coalesce(y >= low, F.lit(False))
    if high is not None:
        ok = ok & F.coalesce(y <= high, F.lit(False))
    return ok


def in_categories(categories: Column, wanted: list[str]) -> Column:
    """Whether a blank-separated list names one of the wanted categories exactly."""
    return F.coalesce(F.arrays_overlap(F.split(strip(categories), r"\s+"), F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def in_category_lists(categories: Column, wanted: list[str]) -> Column:
    """The same for a list of strings, each of which may name several."""
    split = F.flatten(F.transform(F.filter(categories, lambda c: c.isNotNull()), lambda c: F.split(strip(c), r"\s+")))
    return F.coalesce(F.arrays_overlap(split, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def any_contains(value: str, *columns: Column) -> Column:
    """Whether any of the columns (venue, journal, source, url, source url) holds the value, whatever its case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(value.lower()), F.lit(False))
    return out


def author_contains(value: str, names: Column, listed: Column) -> Column:
    """Whether an author string, or a list of authors joined by blanks where there is none, holds the value."""
    text = F.coalesce(F.nullif(names, F.lit("")), F.array_join(listed, " "), F.lit(""))
    return F.lower(text).contains(value.lower())


def citations(*columns: Column) -> Column:
    """The first of several counts that is a number, as a whole number; 0 if none is."""
    return F.coalesce(*[F.nullif(c, F.lit(float("nan"))).cast("double") for c in columns], F.lit(0.0)).cast("long")


def in_field(categories: Column, field: str) -> Column:
    """Whether any category holds ``field`` or starts with it and a point."""
    return F.coalesce(F.exists(categories, lambda c: F.lower(c).contains(field.lower()) | F.lower(c).startswith(field.lower() + ".")), F.lit(False))


def trimmed(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def card(rank: Column, title: Column, authors: Column, date: Column, score: Column) -> Column:
    """A result's display struct: title on one line (or its place), authors, day, score to three digits."""
    return F.struct(
        F.coalesce(F.nullif(strip(F.regexp_replace(title, r"\s*\R\s*", " ")), F.lit("")), F.concat(F.lit("Result "), rank.cast("string"))).alias("title"),
        first_non_empty(authors).alias("authors"),
        date_part(date).alias("date"),
        F.when(score.isNotNull(), F.format_string("%.3f", F.floor(score.cast("double") * 1000 + 0.5) / 1000)).alias("score"),
    )


def one_line(c: Column, most: int = 420) -> Column:
    """A text on one line, cut with an ellipsis; empty for null."""
    return trimmed(strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")), most)


def link(url: Column, path: Column) -> Column:
    """The url, else the file's path as one; empty if both are."""
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("file://"), F.nullif(path, F.lit(""))), F.lit(""))


def known(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in which none of the keys is null or empty."""
    for k in keys:
        df = df.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return df


def source_fields(df: DataFrame, includes: list[str]) -> DataFrame:
    """The named columns, as far as the table has them."""
    return df.select(*[c for c in includes if c in df.columns])


def vector_md5(v: Column) -> Column:
    """md5 of a vector written with six digits a number."""
    return F.md5(F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x.cast("double"))), ""))


def zip_checked(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Two lists as one of structs, place by place; an error if their lengths differ."""
    pairs = F.arrays_zip(a.alias(names[0]), b.alias(names[1]))
    return F.when(F.size(a) == F.size(b), pairs).otherwise(F.raise_error(F.concat(F.size(b).cast("string"), F.lit(" values for "), F.size(a).cast("string"))))


def top_k_bound(wanted: Column, initial: int = 50, shown: int = 15) -> Column:
    """A number of results within 1 and ``initial``; ``shown`` (at most ``initial``) if none is given."""
    return F.coalesce(F.least(F.greatest(wanted, F.lit(1)), F.lit(initial)), F.lit(min(shown, initial)))


def rerank_text(title: Column, *bodies: Column, separator: str = " [SEP] ") -> Column:
    """What a cross-encoder reads: the title, and the first body that isn't blank."""
    return F.concat_ws(separator, first_non_empty(title), first_non_empty(*bodies))
