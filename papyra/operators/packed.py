"""Split fields that pack several values: each field is parsed by the dialect that describes it most briefly.

A dialect is a set of delimiters with a quoting convention. Every field is parsed under every dialect whose delimiters
occur in it; a parse costs the bits that name its dialect, the choice of delimiter at each cut, and the code length of each
value. A value is coded by its own frequency in its column, plus its share of the bits that spell it in the code book, or
by the frequency of its shape plus spelling it out. Frequencies are counted over the whole column; the first count weighs
all parses of a field alike, the later ones hold the parses chosen before.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.latest import latest_rows
from papyra.storage import stage

#: delimiters by name; a blank delimits only alone, as it also surrounds the others
DELIMITERS = {"semicolon": r";+", "bar": r"\|", "slash": r"\s/\s", "line": r"\n", "tab": r"\t", "comma": r",", "and": r"\band\b", "ampersand": r"&"}
_PRESENT = {k: re.compile(v) for k, v in DELIMITERS.items()}
_LIST = re.compile(r"^\[(.*)\]$", re.S)
_BLANK = re.compile(r"\S\s+\S")
_SHAPE = re.compile(r"[^\W\d_]+|\d+|\s+")
_QUOTED = r'"(?:[^"\\]|\\.|"")*"'
_ITEM = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^,]*?))\s*(?:,|$)""", re.S)
_cut: dict[tuple[str, ...], re.Pattern] = {}

BITS_PER_CHARACTER = 5.0
#: of a shape in the code book
BITS_PER_SIGN = 2.0
#: of a quote or a delimiter that stands within a value
BITS_PER_QUOTE, BITS_PER_DELIMITER = 8.0, 3.0


@lru_cache(maxsize=200_000)
def shape(value: str) -> str:
    """The value with each word as X (capitalised), A (one capital), C (capitals) or x, and numbers as 9."""

    def one(m: re.Match) -> str:
        w = m.group()
        if w.isspace():
            return "\n" if "\n" in w else "\t" if "\t" in w else " "
        if w.isdigit():
            return "9"
        if len(w) == 1:
            return "A" if w.isupper() else "a"
        return "C" if w.isupper() else "X" if w[0].isupper() else "x"

    return _SHAPE.sub(one, value)


def _unquote(v: str) -> str:
    v = v.strip()
    if len(v) > 1 and v[0] == v[-1] == '"':
        v = re.sub(r"\\(.)", r"\1", v[1:-1].replace('""', '"')).strip()
    return v


def _list_items(body: str) -> list[str]:
    out, at = [], 0
    while at < len(body):
        m = _ITEM.match(body, at)
        if not m or m.end() == at:
            break
        dq, sq, bare = m.groups()
        v = dq if dq is not None else sq if sq is not None else bare
        if bare is None:
            v = re.sub(r"\\u([0-9a-fA-F]{4})", lambda x: chr(int(x.group(1), 16)), v)
            v = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x.group(1), x.group(1)), v)
        out.append(v)
        at = m.end()
    return out


def _cut_by(text: str, names: tuple[str, ...], quoting: bool) -> tuple[list[str], int]:
    """Values and number of cuts; a quoted stretch is never cut."""
    key = (*names, "quoted") if quoting else names
    if key not in _cut:
        alternatives = "|".join(DELIMITERS.get(n, r"\s+") for n in names)
        _cut[key] = re.compile(f"({_QUOTED})|({alternatives})" if quoting else f"()({alternatives})")
    out, start, cuts = [], 0, 0
    for m in _cut[key].finditer(text):
        if m.group(2):
            out.append(text[start : m.start()])
            start, cuts = m.end(), cuts + 1
    out.append(text[start:])
    return out, cuts


@lru_cache(maxsize=200_000)
def _signs(value: str) -> float:
    """Bits for signs that a value holds as content though they usually delimit or quote; no code book makes them free."""
    return BITS_PER_QUOTE * value.count('"') + BITS_PER_DELIMITER * sum(len(p.findall(value)) for n, p in _PRESENT.items() if n != "comma")


def parses(text: str) -> Iterator[tuple[str, list[str], float]]:
    """Every dialect that fits ``text``: its name, the values it gives, and the bits spent on delimiters."""
    s = text.strip()
    m = _LIST.match(s)
    if m:
        yield "list", [x for x in (v.strip() for v in _list_items(m.group(1))) if x], 0.0
    quoting = [True, False] if '"' in s else [False]
    present = [n for n, p in _PRESENT.items() if p.search(s)]
    sets = [c for k in range(len(present) + 1) for c in combinations(present, k)]
    if _BLANK.search(s):
        sets.append(("blank",))
    for q in quoting:
        for names in sets:
            raw, cuts = _cut_by(s, names, q) if names else ([s], 0)
            vals = [_unquote(v) if q else v.strip() for v in raw]
            vals = [v for v in vals if v]
            yield "+".join(names) + (" quoted" if q else ""), vals, cuts * math.log2(max(1, len(names))) + sum(map(_signs, vals))
        if "comma" in present and not q:
            # every other comma stands within a name written surname first
            rest = [n for n in present if n in ("and", "ampersand")]
            parts = [v for v in (v.strip() for v in _cut_by(s, ("comma", *rest), q)[0]) if v]
            if len(parts) > 2 and len(parts) % 2 == 0:
                yield "comma pairs", [f"{a}, {b}" for a, b in zip(parts[::2], parts[1::2])], 0.0


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, field, text, n) -> a row for each dialect that cuts the text in a way of its own."""
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            rows: list[list] = [[] for _ in range(8)]
            for tid, field, text, n in zip(*(c.to_pylist() for c in b.slice(lo, 500).columns)):
                seen: set[tuple[str, ...]] = set()
                for name, vals, bits in parses(text):
                    # a dialect that cuts as a simpler one did adds nothing
                    if tuple(vals) in seen:
                        continue
                    for col, v in zip(rows, (tid, tid * PARSES + len(seen), field, n, name, bits, vals, [shape(v) for v in vals])):
                        col.append(v)
                    seen.add(tuple(vals))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["tid", "pid", "field", "n", "dialect", "bits", "vals", "shapes"])


#: no text has as many parses: the subsets of the delimiters, with and without quotes, and three more
PARSES = 1024


def _vocabulary(texts: DataFrame, parsed: DataFrame) -> DataFrame:
    """(vh, sh, field, lv, ls, spelt): every distinct value of any parse and its shape by number, their lengths, and the bits
    that spell the value's words.

    A word costs by its frequency in the column's raw text, whatever the dialect."""
    word = lambda c: F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), 1)
    counts = texts.select("field", "n", F.explode(word("text")).alias("w")).groupBy("field", "w").agg(F.sum("n").alias("n"))
    total = counts.groupBy("field").agg(F.sum("n").alias("t"))
    bits = counts.join(F.broadcast(total), "field").select("field", "w", F.log2(F.col("t") / F.col("n")).alias("bits"))  # a row per field
    z = F.arrays_zip(F.col("vh").alias("vh"), F.col("sh").alias("sh"), F.col("vals").alias("v"), F.col("shapes").alias("s"))
    # of each value its text once, before words are counted off it
    values = stage(parsed.select("field", F.explode(z).alias("z")).groupBy("z.vh").agg(F.first("field").alias("field"), F.first("z.sh").alias("sh"), F.first("z.v").alias("v"), F.first(F.length("z.s")).alias("ls")), "packed-values")
    spelt = values.select("vh", "field", F.explode(word("v")).alias("w")).join(bits, ["field", "w"]).groupBy("vh").agg(F.sum("bits").alias("spelt"))
    return values.join(spelt, "vh", "left").select("vh", "sh", "field", F.length("v").alias("lv"), "ls", F.coalesce("spelt", F.lit(0.0)).alias("spelt"))


#: a value taking more than this part of its field is joined by broadcast: there are at most so many per field
FREQUENT = 1 / 2000
#: a parse goes on to the next round if it costs at most so many times as much as the cheapest of its text, plus so many bits
KEPT_TIMES, KEPT_BITS = 1.5, 40.0


def _costed(tried: DataFrame, weighted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tid, pid, k, cost): what each parse of ``tried`` costs under the code lengths that ``weighted`` implies."""
    counted = lambda c: weighted.select("weight", F.explode(c).alias(c)).groupBy(c).agg(F.sum("weight").alias(f"n_{c}"))
    dialects = weighted.groupBy("field", "dialect").agg(F.sum("weight").alias("nd"))
    fields = stage(weighted.groupBy("field").agg(F.sum("weight").alias("td"), F.greatest(F.lit(1.0), F.sum(F.col("weight") * F.size("vh"))).alias("total")), "packed-fields")
    known = vocabulary.join(counted("vh"), "vh", "left").join(counted("sh"), "sh", "left").join(F.broadcast(fields.select("field", "total")), "field", "left")
    total = F.coalesce("total", F.lit(1.0)) + 1
    by_value = F.log2(total / F.col("n_vh")) + F.col("lv") * BITS_PER_CHARACTER / F.greatest(F.lit(1.0), F.col("n_vh"))
    n_s = F.coalesce("n_sh", F.lit(0.0))
    by_shape = F.log2(total / (n_s + 0.05)) + F.col("ls") * BITS_PER_SIGN / F.greatest(F.lit(1.0), n_s) + F.col("spelt")
    costs = stage(known.select("vh", (F.least(by_value, by_shape) + 1.0).alias("cost"), (F.col("n_vh") > F.col("total") * FREQUENT).alias("common")), "packed-costs")
    rows = tried.select("pid", F.explode("vh").alias("vh"))
    # frequent values by broadcast, as their number is bounded; no other value is frequent enough to make a hot key
    common = F.broadcast(costs.where("common").select("vh", F.col("cost").alias("c")))
    met = rows.join(common, "vh", "left")
    rest = met.where("c is null").drop("c").join(costs.where("common is null or not common").select("vh", F.col("cost").alias("c")), "vh")
    cost = met.where("c is not null").select(*rest.columns).unionByName(rest).groupBy("pid").agg(F.sum("c").alias("c"))
    one = tried.select("tid", "pid", "field", "dialect", "bits", F.size("vh").alias("k")).join(cost, "pid", "left")
    # at most a few hundred dialects a field, by their construction
    one = one.join(F.broadcast(dialects), ["field", "dialect"], "left").join(F.broadcast(fields.select("field", "td")), "field", "left")
    full = F.coalesce("c", F.lit(0.0)) + F.col("bits") + F.log2((F.col("td") + 1) / (F.coalesce("nd", F.lit(0.0)) + 0.5))
    return one.select("tid", "pid", "k", full.alias("cost"))


def split_packed(fields: DataFrame, rounds: int = 3) -> DataFrame:
    """``(rec_id, field, pos, val)`` from ``(rec_id, field, text)``: one row per value, positions from 1.

    Values lose surrounding white space, list brackets, enclosing quotes and quote escapes; empty ones are left out and take
    no position, repeated ones stay. Null ids, fields and texts, and blank texts, give no rows. A record's field should stand
    in one row; equal rows count once. ``rounds`` is the number of times code lengths are counted and parses chosen; parses
    far behind the cheapest of their text (``KEPT_TIMES``, ``KEPT_BITS``) aren't tried again. Equal texts are parsed once and
    weigh as often as they stand; values and shapes travel as 64-bit numbers.
    """
    rows = fields.select("rec_id", "field", "text").where("rec_id is not null and field is not null and trim(text) <> ''").distinct()
    texts = stage(rows.groupBy("field", "text").agg(F.count("*").alias("n")).withColumn("tid", F.pmod(F.monotonically_increasing_id(), F.lit(2**52))), "packed-texts")
    out = texts.select("tid", "field", "text", "n").mapInArrow(_parse, "tid long, pid long, field string, n long, dialect string, bits double, vals array<string>, shapes array<string>")
    numbers = [F.transform(c, lambda v: F.xxhash64("field", v)).alias(h) for c, h in (("vals", "vh"), ("shapes", "sh"))]
    parsed = stage(out.select("*", *numbers), "packed-parses")
    vocabulary = stage(_vocabulary(texts, parsed), "packed-vocabulary")
    tried = parsed.select("tid", "pid", "field", "n", "dialect", "bits", "vh", "sh")
    # blanks are no evidence before values are known
    plain = tried.where("dialect not like 'blank%'")
    weighted = plain.join(plain.groupBy("tid").agg(F.count("*").alias("parses")), "tid").withColumn("weight", F.col("n") / F.col("parses"))
    for r in range(rounds):
        cost = stage(_costed(tried, weighted, vocabulary), "packed-cost")
        best = stage(cost.groupBy("tid").agg(F.min(F.struct("cost", "k", "pid")).alias("b")).select("tid", F.col("b.pid").alias("pid"), F.col("b.cost").alias("least")), "packed-best")
        if r + 1 < rounds:
            near = cost.join(best.select("tid", "least"), "tid").where(F.col("cost") <= F.col("least") * KEPT_TIMES + KEPT_BITS).select("pid")
            tried = stage(tried.join(near, "pid"), "packed-tried")
            weighted = tried.join(best.select("pid"), "pid", "left_semi").withColumn("weight", F.col("n").cast("double"))
    chosen = parsed.select("tid", "pid", "vals").join(best.select("pid"), "pid", "left_semi").select("tid", "vals")
    whole = texts.select("tid", "field", "text").join(chosen, "tid").select("field", "text", "vals")
    out = rows.join(whole, ["field", "text"]).select("rec_id", "field", F.posexplode("vals").alias("p", "val"))
    return out.select("rec_id", "field", (F.col("p") + 1).alias("pos"), "val")


def packed_fields(table: DataFrame, key: str, names: list[str], order: str) -> DataFrame:
    """Long rows ``(rec_id, field, text)`` of the named columns, of each record's latest delivery."""
    latest = latest_rows(table.select(key, order, *names), [key], order)
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names])
    return latest.select(F.col(key).alias("rec_id"), F.explode(pairs).alias("x")).select("rec_id", "x.field", "x.text")
