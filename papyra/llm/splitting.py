"""Cut oversized texts into overlapping pieces at the valleys of lexical cohesion."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.latest import latest_rows, without_superseded
from papyra.storage import small_side

TOKEN = re.compile(r"\S+")
SENTENCE_END = re.compile(r"[.!?…。][\"'’”)\]]*$")
CLAUSE_END = re.compile(r"[,;:—)\]]$")
_DIMS = 256


def cohesion(tokens: list[str], block: int = 24, stretch: int = 8192) -> np.ndarray:
    """For each gap before token i (1..n-1): cosine between the words of the ``block`` tokens before and after it.

    Counts are held for ``stretch`` tokens at a time, so that memory doesn't grow with the text."""
    n = len(tokens)
    where = np.full(n, -1)
    for i, t in enumerate(tokens):
        w = t.lower().strip(".,;:!?()[]\"'")
        if len(w) > 3:  # short words are mostly function words
            where[i] = xxhash.xxh32_intdigest(w) % _DIMS
    out = np.zeros(max(0, n - 1), np.float32)
    for lo in range(1, n, stretch):
        hi = min(n, lo + stretch)
        a, b = max(0, lo - block), min(n, hi + block)
        bag = np.zeros((b - a + 1, _DIMS), np.float32)
        said = np.flatnonzero(where[a:b] >= 0)
        bag[said + 1, where[a:b][said]] = 1
        total = np.cumsum(bag, axis=0)
        at = np.arange(lo, hi) - a
        left = total[at] - total[np.maximum(0, at - block)]
        right = total[np.minimum(b - a, at + block)] - total[at]
        norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
        out[lo - 1 : hi - 1] = (left * right).sum(1) / np.maximum(norm, 1e-9)
    return out


def depths(sim: np.ndarray) -> np.ndarray:
    """How far each gap lies below the nearest peaks on both sides (climbing while the curve does not fall)."""
    n = len(sim)
    left, right = sim.copy(), sim.copy()
    for i in range(1, n):
        left[i] = max(sim[i], left[i - 1]) if sim[i - 1] >= sim[i] else sim[i]
    for i in range(n - 2, -1, -1):
        right[i] = max(sim[i], right[i + 1]) if sim[i + 1] >= sim[i] else sim[i]
    return left + right - 2 * sim


def cuts(text: str, spans: list[tuple[int, int]], limit: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Token ranges of the pieces: each ends at the deepest valley of its window.

    Sentence and paragraph ends come first, clause ends where the window has none, any gap where it has neither. A window
    runs from the first cut that leaves a new token to the limit; a piece under half of the limit costs depth in proportion,
    so that a shallow early valley doesn't shorten pieces."""
    n = len(spans)
    if n <= limit:
        return [(0, n)]
    tokens = [text[a:b] for a, b in spans]
    # strength of the pause before token i
    pause = np.zeros(n + 1, np.int8)
    for i in range(1, n):
        gap = text[spans[i - 1][1] : spans[i][0]]
        if gap.count("\n") > 1:
            pause[i] = 3
        elif "\n" in gap or SENTENCE_END.search(tokens[i - 1]):
            pause[i] = 2
        elif CLAUSE_END.search(tokens[i - 1]):
            pause[i] = 1
    similar = np.concatenate([[0.0], cohesion(tokens), [0.0]])
    valleys: dict[int, np.ndarray] = {}

    def valley(kind: int) -> np.ndarray:
        """How deep each gap of at least this pause lies among its like."""
        if kind not in valleys:
            at = np.flatnonzero(pause[1:n] >= kind) + 1
            valleys[kind] = np.zeros(n + 1)
            valleys[kind][at] = depths(similar[at]) + 0.15 * (pause[at] == 3)
        return valleys[kind]

    out, s = [], 0
    while n - s > limit:
        low, high = s + overlap + 1, s + limit
        at = np.arange(low, high + 1)
        fit = at[(n - at + overlap >= least) | (at == high)]
        kind = min(2, int(pause[fit].max()))
        fit = fit[pause[fit] >= kind]
        short = np.maximum(0.0, 1 - (fit - s) / max(1.0, limit / 2))
        e = int(fit[np.lexsort((-fit, short - valley(kind)[fit]))[0]])
        out.append((s, e))
        s = e - overlap
    out.append((s, n))
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[] for _ in range(7)]
        for i, text, title, limit, overlap, least in zip(*(c.to_pylist() for c in b.columns)):
            if len(text.split()) <= limit:
                continue
            spans = [m.span() for m in TOKEN.finditer(text)]
            for k, (s, e) in enumerate(cuts(text, spans, limit, min(overlap, limit - 1), least)):
                a, z = spans[s][0], spans[e - 1][1]
                for col, v in zip(rows, (i, k, text[a:z], e - s, a, z, title)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["chunk_id", "piece", "text", "token_count", "char_start", "char_end", "section_title"])


PIECES = "chunk_id string, piece int, text string, token_count int, char_start int, char_end int, section_title string"


def split_oversized(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """``(chunk_id, piece, text, token_count, char_start, char_end, section_title)``, pieces from 0, of every oversized text.

    Tokens are runs of non-whitespace characters; a text is oversized if it has more of them than its configuration's
    ``tokens_per_chunk``. Each piece but the last ends at the deepest cohesion valley of its window: among sentence and
    paragraph ends, else clause ends, else all gaps; the next piece starts ``overlap_tokens`` before that end (at most the
    limit less one). Texts keep their inner white space.

    Texts at or under the limit, null or blank texts, null ids, and chunks without a known configuration or with a limit
    below 1 give no rows. A null or blank section title becomes the configuration's default. Of a chunk delivered several
    times the latest row counts, so that a newer short one leaves no pieces; of rows of equal time an oversized one counts
    first. Other columns of the inputs are not read.
    """
    c = chunks.select("id", "text", "section_title", "config_id", "ingested_at").where("id is not null and text is not null")
    k = configs.select("config_id", F.col("tokens_per_chunk").alias("lim"), F.coalesce("overlap_tokens", F.lit(0)).alias("ov"), F.coalesce("min_chunk_tokens", F.lit(0)).alias("least"), "default_section_title").where("lim >= 1").dropDuplicates(["config_id"])
    # a text of more than n tokens has at least 2 n + 1 characters: settled before any text leaves the JVM
    rows = c.join(small_side(k), "config_id").where(F.length("text") > 2 * F.col("lim"))
    rows = latest_rows(without_superseded(rows, chunks, ["id"], "ingested_at"), ["id"], "ingested_at")
    title = F.coalesce(F.when(F.trim("section_title") != "", F.col("section_title")), "default_section_title")
    return rows.select("id", "text", title.alias("title"), "lim", F.greatest("ov", F.lit(0)).alias("ov"), "least").mapInArrow(_split, PIECES)
