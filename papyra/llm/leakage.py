"""Evaluation passages inside a corpus: an FM-index per shard, searched for every phrase at once.

A phrase is ``phrase_words`` consecutive words of a test item. Each task turns its documents into word numbers over the
phrases' vocabulary, keeps the runs of such words that are long enough to hold a phrase, and builds their Burrows-Wheeler
transform, a wavelet matrix over it, and sampled suffix positions. Backward search takes all phrases one word further at
a time; occurrences are located by walking to a sampled position, and overlapping ones merged into spans to remove.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyra.llm.words import WORD, words


class WaveletMatrix:
    """rank of a symbol in a prefix of a sequence, for arrays of questions."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        cur = seq
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(int(len(cur) - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands among the first ``upto`` entries."""
        lo, hi = np.zeros_like(upto), upto.copy()
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[k][lo], self.ones[k][hi]
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``, whose last symbol is 0. Every 0 ends a suffix: zeros differ, by position.

    Prefix doubling; each round sorts only the suffixes still tied."""
    n = len(text)
    zeros = text == 0
    rank = np.empty(n, np.int64)
    rank[zeros] = np.arange(zeros.sum())
    counts = np.bincount(text)
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    rank[~zeros] = start[text[~zeros]]
    tied = np.flatnonzero(~zeros & (counts[text] > 1))
    step = 1
    while len(tied):
        key = rank[tied] * (n + 1) + rank[tied + step]
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        group = rank[tied]
        at = np.arange(len(tied))
        new_group = np.append(True, group[1:] != group[:-1])
        new_key = np.append(True, key[1:] != key[:-1])
        base = np.maximum.accumulate(np.where(new_group, at, 0))
        first = np.maximum.accumulate(np.where(new_key, at, 0))
        rank[tied] = group + first - base
        size = np.diff(np.append(np.flatnonzero(new_key), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FmIndex:
    """FM-index of a sequence of words (1..symbols-1) whose runs end in 0."""

    def __init__(self, text: np.ndarray, symbols: int, every: int = 32):
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.tree = WaveletMatrix(self.bwt, symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        # sampled: every so many positions, and each run's first, so that no walk crosses a 0
        self.sampled = (sa % every == 0) | (self.bwt == 0)
        self.position = np.where(self.sampled, sa, -1)
        self.rows = len(text)

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of the suffixes that start with each phrase (rows of ``phrases``)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.rows, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            lo[alive], hi[alive] = self._step(c, lo[alive]), self._step(c, hi[alive])
            dead = alive[lo[alive] >= hi[alive]]
            hi[dead] = lo[dead]
            alive = alive[lo[alive] < hi[alive]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        row, walked = rows.copy(), np.zeros(len(rows), np.int64)
        going = np.flatnonzero(~self.sampled[row])
        while len(going):
            row[going] = self._step(self.bwt[row[going]], row[going])
            walked[going] += 1
            going = going[~self.sampled[row[going]]]
        return self.position[row] + walked


@dataclass
class Phrases:
    """All phrases of a block of items: rows of word numbers, with the item each belongs to."""

    vocabulary: dict[str, int]
    phrases: np.ndarray
    item: np.ndarray

    @staticmethod
    def of(items: list[tuple[int, str]], width: int) -> Phrases:
        vocabulary: dict[str, int] = {}
        rows, owner = [], []
        for i, text in items:
            w = words(text)
            if len(w) < width:
                continue
            n = np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w])
            rows.append(np.lib.stride_tricks.sliding_window_view(n, width))
            owner.append(np.full(len(n) - width + 1, i, np.int64))
        if not rows:
            return Phrases({}, np.zeros((0, width), np.int64), np.zeros(0, np.int64))
        return Phrases(vocabulary, np.concatenate(rows), np.concatenate(owner))


def _scan(shared, width: int, shard_words: int):
    def flush(p: Phrases, runs: list, held: list) -> Iterator[pa.RecordBatch]:
        length = np.array([len(r) for r, _, _ in runs])
        start = np.concatenate([[0], np.cumsum(length + 1)])
        text = np.zeros(start[-1], np.int64)
        for s, (r, _, _) in zip(start, runs):
            text[s : s + len(r)] = r
        distinct, which = np.unique(p.phrases, axis=0, return_inverse=True)
        ix = FmIndex(text, len(p.vocabulary) + 1)
        lo, hi = ix.search(distinct)
        lo, hi = lo[which.ravel()], hi[which.ravel()]
        n = hi - lo
        if not n.sum():
            return
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at, item = ix.locate(rows), np.repeat(p.item, n)
        run = np.searchsorted(start, at, "right") - 1
        doc = np.array([d for _, d, _ in runs])[run]
        word = np.array([w for _, _, w in runs])[run] + at - start[run]
        order = np.lexsort((word, item, doc))
        doc, item, word = doc[order], item[order], word[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] > word[:-1] + width)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        out: list[list] = [[], [], [], [], [], []]
        spans_of, spans = -1, []
        for f, e in zip(first, last):
            d = doc[f]
            if d != spans_of:
                spans_of, spans = d, _word_spans(held[d][1])
            a, b = int(word[f]), int(word[e]) + width
            for col, v in zip(out, (held[d][0], int(item[f]), a, b, spans[a][0], spans[b - 1][1])):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.int32()) for c in out[2:])], ["doc_id", "item_id", "word_start", "word_end", "char_start", "char_end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        number = p.vocabulary.get
        runs: list = []
        held: list = []
        total = 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = [number(x, 0) for x in words(text)]
                if len(w) < width:
                    continue
                n = np.array(w)
                gaps = np.concatenate([[-1], np.flatnonzero(n == 0), [len(n)]])
                long = np.flatnonzero(np.diff(gaps) > width)
                if not len(long):
                    continue
                for g in long:
                    runs.append((n[gaps[g] + 1 : gaps[g + 1]], len(held), gaps[g] + 1))
                    total += gaps[g + 1] - gaps[g]
                held.append((i, text))
                if total >= shard_words:
                    yield from flush(p, runs, held)
                    runs, held, total = [], [], 0
        if runs:
            yield from flush(p, runs, held)

    return run


def _word_spans(text: str) -> list[tuple[int, int]]:
    """Where each of ``words(text)`` stands in ``text`` itself, also where lower case takes more characters."""
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[a], origin[b - 1] + 1) for a, b in spans]


SPANS = "doc_id long, item_id long, word_start int, word_end int, char_start int, char_end int"


def leaked_spans(documents: DataFrame, items: DataFrame, phrase_words: int = 12, shard_words: int = 2_000_000, block_items: int = 20_000, block_bytes: int = 16 << 20) -> DataFrame:
    """``(doc_id, item_id, word_start, word_end, char_start, char_end)``: each stretch of a document made of phrases of an
    item, overlapping or adjoining ones merged; ends are exclusive.

    Words are runs of letters and digits in lower case, so case, punctuation and white space don't matter. Items are taken
    ``block_items`` at a time, or as many as have ``block_bytes`` of text, each block against all documents. Rows with a null id or text are left out; items and texts
    of fewer words than a phrase match nothing; a repeated document row gives repeated spans. A shard is closed at
    ``shard_words`` words that can be part of a phrase, so a long text makes its shard longer, never cut.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    out, block, size = None, [], 0

    def one(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(Phrases.of(block, phrase_words))
        return docs.mapInArrow(_scan(shared, phrase_words, shard_words), SPANS)

    for r in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text.encode())
        if len(block) == block_items or size >= block_bytes:
            out, block, size = one(block) if out is None else out.unionByName(one(block)), [], 0
    if block or out is None:
        out = one(block) if out is None else out.unionByName(one(block))
    return out
