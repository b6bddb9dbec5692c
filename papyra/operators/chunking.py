"""Cutting texts into windows, sentence groups, sub-chunks and scored parents."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import heading, sentences, tokens


def token_windows(docs: DataFrame, size: int = 512, overlap: int = 128, least: int = 40) -> DataFrame:
    """``(id, chunk, token_start, token_end, text)``: windows of ``size`` tokens, each starting ``size - overlap`` after the one
    before; a window shorter than ``least`` is kept only if it is the first. Tokens are joined by single blanks.

    The windows follow in closed form from the number of tokens, so there is no loop over them."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to less than size")
    step = size - overlap
    d = docs.select("id", tokens(F.col("text")).alias("t")).where("size(t) > 0").withColumn("n", F.size("t"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    w = d.select("id", "t", "n", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).where((F.col("chunk") == 0) | (F.col("n") - F.col("chunk") * step >= least))
    start = F.col("chunk") * step
    return w.select("id", "chunk", start.alias("token_start"), F.least(start + size, F.col("n")).alias("token_end"), F.array_join(F.slice("t", start + 1, size), " ").alias("text"))


def sentence_groups(docs: DataFrame, size: int) -> DataFrame:
    """``(id, chunk, sent_start, sent_end, text)``: every ``size`` sentences joined by blanks, ends exclusive."""
    d = docs.select("id", sentences(F.col("text")).alias("s")).where("size(s) > 0")
    last = (F.ceil(F.size("s") / size) - 1).cast("int")
    g = d.select("id", "s", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    start = F.col("chunk") * size
    return g.select("id", "chunk", start.alias("sent_start"), F.least(start + size, F.size("s")).alias("sent_end"), F.array_join(F.slice("s", start + 1, size), " ").alias("text"))


def balanced_parts(docs: DataFrame, parts: int) -> DataFrame:
    """``(id, part, sent_start, sent_end, text)``: sentences in ``parts`` runs of nearly equal length, the first ones longer;
    fewer runs if there are fewer sentences."""
    d = docs.select("id", sentences(F.col("text")).alias("s")).where("size(s) > 0").withColumn("n", F.size("s"))
    k = F.least(F.lit(parts), F.col("n"))
    g = d.withColumn("k", k).withColumn("part", F.explode(F.sequence(F.lit(0), k - 1)))
    base, rest = F.floor(F.col("n") / F.col("k")).cast("int"), F.col("n") % F.col("k")
    start = F.col("part") * base + F.least("part", rest)
    length = base + F.when(F.col("part") < rest, 1).otherwise(0)
    return g.select("id", "part", start.cast("int").alias("sent_start"), (start + length).cast("int").alias("sent_end"), F.array_join(F.slice("s", (start + 1).cast("int"), length.cast("int")), " ").alias("text"))


def heading_lines(docs: DataFrame) -> DataFrame:
    """``(id, line, title)``: lines of the text that read as headings."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("line", "title"))
    return lines.select("id", "line", F.regexp_replace("title", r"^\s+|\s+$", "").alias("title")).where(heading(F.col("title")))


def _window(words: list[int], at: int, least_words: int, most_sentences: int, least_sentences: int) -> int:
    """Where the window that starts at sentence ``at`` ends."""
    end, n = at, 0
    while end < len(words) and end - at < most_sentences:
        n += words[end]
        end += 1
        if n >= least_words and end - at >= least_sentences:
            break
    return end


def _split(scores: list[float | None], window: int, reuse: bool) -> tuple[int, float]:
    """(sentences taken, probability): the latest of the most probable splits. Where a score is missing, those before it count:
    without reuse with probability NaN, and none of them takes the whole window; with reuse none of them takes one sentence."""
    known = scores[: scores.index(None)] if None in scores else scores
    if not known:
        return (1 if reuse else window), float("nan")
    best = max(range(len(known)), key=lambda k: (known[k], k))
    return best + 1, known[best] if reuse or len(known) == len(scores) else float("nan")


def _parents(scorer: Callable[[list[str]], list[float | None]], least_words: int, most_sentences: int, least_sentences: int, reuse: bool, batch: int):
    def run(batches):
        for b in batches:
            docs = [s for s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            words = [[max(1, len(x.split())) for x in s] for _, s in docs]
            at, number, known = [0] * len(docs), [0] * len(docs), [[] for _ in docs]
            rows: list[list] = [[] for _ in range(6)]
            going = list(range(len(docs)))
            while going:  # a window of every unfinished document at a time, so that the scorer gets them together
                ends = [_window(words[d], at[d], least_words, most_sentences, least_sentences) for d in going]
                asked = []
                for d, end in zip(going, ends):
                    known[d] = known[d][: end - at[d]]
                    asked += [" ".join(docs[d][1][at[d] : k]) for k in range(at[d] + len(known[d]) + 1, end + 1)]
                got = iter([p for lo in range(0, len(asked), batch) for p in scorer(asked[lo : lo + batch])])
                left = []
                for d, end in zip(going, ends):
                    n = end - at[d]
                    scores = known[d] + [next(got) for _ in range(n - len(known[d]))]
                    taken, p = _split(scores, n, reuse)
                    cut = at[d] + taken
                    for col, v in zip(rows, (docs[d][0], number[d], at[d], cut, " ".join(docs[d][1][at[d] : cut]), p)):
                        col.append(v)
                    known[d] = scores[taken:] if reuse and None not in scores else []
                    at[d], number[d] = cut, number[d] + 1
                    if cut < len(docs[d][1]):
                        left.append(d)
                going = left
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()))], ["id", "parent", "sent_start", "sent_end", "text", "eos_probability"])

    return run


def scored_parents(docs: DataFrame, scorer: Callable[[list[str]], list[float | None]], least_words: int = 300, most_sentences: int = 30, least_sentences: int = 1, reuse: bool = False, batch: int = 64) -> DataFrame:
    """``(id, parent, sent_start, sent_end, text, eos_probability)``: windows of at least so many words (at most so many
    sentences), each ended where ``scorer`` (texts so far -> probability that a unit ends there, None on failure) is highest,
    the later of equal ones; the next window starts there.

    The scorer gets ``batch`` texts at a time, of all documents of an Arrow batch. ``reuse`` keeps the scores of sentences
    beyond a split for the next window, though they were given for a longer text."""
    d = docs.select(F.col("id").cast("long").alias("id"), sentences(F.col("text")).alias("s")).where("size(s) > 0")
    return d.mapInArrow(_parents(scorer, least_words, most_sentences, least_sentences, reuse, batch), "id long, parent int, sent_start int, sent_end int, text string, eos_probability double")


def section_at(offset: Column, sections: Column) -> Column:
    """Last of the sections (sorted array of structs with ``start``) that starts at or before the offset; null before all."""
    return F.element_at(F.filter(sections, lambda s: s["start"] <= offset), -1)


def page_at(offset: Column, pages: Column) -> Column:
    """First page span holding the offset; an end of null or 0 is open."""
    return F.get(F.filter(pages, lambda p: (F.coalesce(p["start"], F.lit(0)) <= offset) & (F.coalesce(F.nullif(p["end"], F.lit(0)), F.lit(2147483647)) > offset)), F.lit(0))


def near_heading(offset: Column, sections: Column, reach: int = 400) -> Column:
    return F.exists(sections, lambda s: (offset - s["start"]).between(0, reach))
