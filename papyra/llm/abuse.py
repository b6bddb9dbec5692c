"""Scores for abusive, hateful or sexual text: a convolutional classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of two rows of a hashed table (the word and its beginning). Filters of several widths slide over
the words; each keeps its largest response in the document, and a logistic unit weighs these. As only the strongest window
of a filter counts, and filters only ever speak for abuse, one passage decides, however long the document. Words are read with disguises undone first.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.storage import small_side, stage

WIDTHS = (1, 2, 3, 4)
DIMS, FILTERS, ROWS, STEMS = 24, 24, 1 << 15, 1 << 13
PAD = max(WIDTHS) - 1
#: for each place of each width the width's number
WINDOW = [k for k, w in enumerate(WIDTHS) for _ in range(w)]

#: letters of other scripts that look like Latin ones (fixed values)
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏвкмнтгпАВЕКМНОРСТУХІЈЅοανειτκρυσ", "aeopcyxijsdhlbkmhtrnABEKMHOPCTYXIJSoaveitkpuo")
#: digits and signs used for letters (fixed values)
LEET = str.maketrans("013457@$!", "oieastasi")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SPACED = re.compile(r"\b(?:[^\W\d_][.\-_]){2,}[^\W\d_]\b")
_LONE = re.compile(r"[.\-_][a-z][.\-_]")
#: four letters or more, each alone between blanks
_APART = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?![\w*@$])")
_TWO_APART = re.compile(r" [a-z] [a-z] ")
_RUN = re.compile(r"([a-z])\1{2,}")
_TRIPLES = [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]
_WORD = re.compile(r"[^\W_]+(?:[*@$!]+[^\W_]+)*")


def plain_words(text: str) -> list[str]:
    """Words in lower case without marks, disguises undone: invisible signs, look-alike letters, letters spaced by points
    or blanks, digits for letters, and drawn-out letters. Numbers read as 0; masked letters stay as stars."""
    t = text
    if not t.isascii():
        t = unicodedata.normalize("NFKD", _INVISIBLE.sub("", t).translate(LOOKALIKES))
        t = "".join(c for c in t if not unicodedata.combining(c)) if not t.isascii() else t
    t = t.lower()
    if _LONE.search(t):
        t = _SPACED.sub(lambda m: re.sub(r"[.\-_]", "", m.group()), t)
    if _TWO_APART.search(t):
        t = _APART.sub(lambda m: m.group().replace(" ", ""), t)
    if any(x in t for x in _TRIPLES):
        t = _RUN.sub(r"\1", t)
    out = []
    for w in _WORD.findall(t):
        if not w.isalpha():
            if w.isdigit():
                w = "0"
            elif "*" not in w:
                w = w.translate(LEET)
        out.append(w)
    return out


class Lexicon(dict):
    """word -> its number here, and for each number the word's two rows in the table. Number 0 is no word."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int]] = [(-1, -1)]

    def __missing__(self, w: str) -> int:
        self.rows.append((xxhash.xxh32_intdigest(w) % ROWS, ROWS + xxhash.xxh32_intdigest("^" + w[:4]) % STEMS))
        self[w] = n = len(self.rows) - 1
        return n


@dataclass
class Classifier:
    table: np.ndarray
    filters: list[np.ndarray]  # for each width (width, DIMS, FILTERS)
    bias: np.ndarray  # (widths, FILTERS)
    weight: np.ndarray  # (widths, FILTERS)
    base: float
    thresholds: dict[str, float]

    @staticmethod
    def fresh(seed: int) -> Classifier:
        """The table starts from zero, so that words that are never trained say nothing."""
        r = np.random.default_rng(seed)
        table = np.zeros((ROWS + STEMS, DIMS), np.float32)
        filters = [r.normal(0, 1 / np.sqrt(w * DIMS), (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        return Classifier(table, filters, np.zeros((len(WIDTHS), FILTERS), np.float32), np.abs(r.normal(0, 0.3, (len(WIDTHS), FILTERS))).astype(np.float32), -1.0, {})

    def _vectors(self, rows: np.ndarray) -> np.ndarray:
        vec = self.table[rows[:, 0]] + self.table[rows[:, 1]]
        vec[rows[:, 0] < 0] = 0
        return vec

    def _split(self, vec: np.ndarray) -> list[np.ndarray]:
        """For each place of each width (words, FILTERS): each word's share in every filter's response there."""
        return [vec @ f[o] for f in self.filters for o in range(len(f))]

    def _state(self) -> list[np.ndarray]:
        return [self.table, *self.filters, self.bias, self.weight]

    def scores(self, docs: list[np.ndarray], rows: np.ndarray, batch_words: int = 40_000) -> np.ndarray:
        """Scores of documents whose word numbers index ``rows``."""
        split = self._split(self._vectors(rows))
        out, lo = np.zeros(len(docs)), 0
        while lo < len(docs):
            hi, n = lo, 0
            while hi < len(docs) and (n == 0 or n + len(docs[hi]) <= batch_words):
                n += len(docs[hi]) + PAD
                hi += 1
            ids, starts, _ = pack(docs[lo:hi])
            z, buffers = np.full(hi - lo, self.base), np.empty((2, len(ids), FILTERS), np.float32)
            for k in range(len(WIDTHS)):
                resp = _windows(split, ids, k, buffers)
                # the places after a document's last word answer to nothing, or to its last words
                z += np.maximum(np.maximum.reduceat(resp, starts, axis=0) + self.bias[k], 0) @ self.weight[k]
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            lo = hi
        return out

    def fit(self, docs: list[np.ndarray], rows: np.ndarray, y: np.ndarray, epochs: int, seed: int, rate: float = 0.05, decay: float = 3e-4, least: int = 3) -> Classifier:
        """AdaGrad on the logistic loss, classes weighed alike up to a factor of 8. Table rows that fewer than ``least``
        documents use stay at zero: a word seen once or twice can only be learnt by heart."""
        r = np.random.default_rng(seed)
        self.begin(uses(docs, rows), r, least)
        return self.learn(docs, rows, y, epochs, r, self.fresh_sums(), class_weight(y), rate, decay)

    def begin(self, used: np.ndarray, r: np.random.Generator, least: int = 3) -> Classifier:
        frequent = used >= least
        self.table[frequent] = r.normal(0, 0.25, (int(frequent.sum()), DIMS))
        return self

    def fresh_sums(self) -> list:
        """Sums of squared gradients, in the order of the weights, the last of ``base``."""
        return [np.full_like(self.table, 1e-3), [np.full_like(f, 1e-3) for f in self.filters], np.full_like(self.bias, 1e-3), np.full_like(self.weight, 1e-3), 1e-3]

    def learn(self, docs: list[np.ndarray], rows: np.ndarray, y: np.ndarray, epochs: int, r: np.random.Generator, sums: list, up: float, rate: float = 0.05, decay: float = 3e-4) -> Classifier:
        """Steps from where the weights and ``sums`` are; table rows at zero stay there."""
        frequent = self.table.any(axis=1)
        number = np.zeros(len(rows), np.int64)
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for lo in range(0, len(order), 64):
                pick = order[lo : lo + 64]
                ids, starts, ends = pack([docs[i] for i in pick])
                uniq = np.flatnonzero(np.bincount(ids, minlength=len(rows)))
                number[uniq] = np.arange(len(uniq))
                inv = number[ids]
                own = rows[uniq]
                vec = self._vectors(own)
                split = self._split(vec)
                best = np.empty((len(pick), len(WIDTHS), FILTERS), np.float32)
                at = np.empty((len(pick), len(WIDTHS), FILTERS), np.int64)
                buffers = np.empty((2, len(ids), FILTERS), np.float32)
                spans, cols = list(zip(starts.tolist(), ends.tolist())), np.arange(FILTERS)
                for k in range(len(WIDTHS)):
                    resp = _windows(split, inv, k, buffers)
                    for d, (first, last) in enumerate(spans):
                        resp[first:last].argmax(0, out=at[d, k])
                    at[:, k] += starts[:, None]
                    best[:, k] = resp[at[:, k], cols]
                best += self.bias
                h = np.maximum(best, 0)
                keep = (r.random(h.shape) > 0.25) / 0.75
                z = (h * keep * self.weight).sum((1, 2)) + self.base
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                dz = ((p - y[pick]) * np.where(y[pick] == 1, up, 1.0) / len(pick)).astype(np.float32)
                dw = (dz[:, None, None] * h * keep).sum(0) + decay * self.weight
                dh = (dz[:, None, None] * self.weight * keep * (best > 0)).astype(np.float32)
                # share[word, c, f]: what the word's response in place c of a window to filter f changes
                word = [inv[np.minimum(at[:, k] + o, len(inv) - 1)] for k, w in enumerate(WIDTHS) for o in range(w)]
                use = [(own[x, 0] >= 0) & (dh[:, k] != 0) for x, k in zip(word, WINDOW)]
                t = np.concatenate([x[on] for x, on in zip(word, use)])
                words = np.flatnonzero(np.bincount(t, minlength=len(uniq)))
                among = np.zeros(len(uniq), np.int64)
                among[words] = np.arange(len(words))
                place = [(among[x] * len(WINDOW) + c) * FILTERS + np.arange(FILTERS) for c, x in enumerate(word)]
                share = np.bincount(np.concatenate([x[on] for x, on in zip(place, use)]), np.concatenate([dh[:, k][on] for k, on in zip(WINDOW, use)]), len(words) * len(WINDOW) * FILTERS)
                share = share.astype(np.float32).reshape(len(words), len(WINDOW) * FILTERS)
                gf = (vec[words].T @ share).reshape(DIMS, len(WINDOW), FILTERS)
                g = share @ np.concatenate([f[o] for f in self.filters for o in range(len(f))], axis=1).T
                for c, (k, o) in enumerate((k, o) for k, w in enumerate(WIDTHS) for o in range(w)):
                    gw = gf[:, c] + decay * self.filters[k][o]
                    sums[1][k][o] += gw * gw
                    self.filters[k][o] -= rate * gw / np.sqrt(sums[1][k][o])
                if len(words):
                    for c in (0, 1):
                        by = np.argsort(own[words, c], kind="stable")
                        u, first = np.unique(own[words[by], c], return_index=True)
                        gu = np.add.reduceat(g[by], first, axis=0)
                        gu[~frequent[u]] = 0
                        sums[0][u] += gu * gu
                        self.table[u] -= rate * gu / np.sqrt(sums[0][u])
                db = dh.sum(0)
                sums[2] += db * db
                self.bias -= rate * db / np.sqrt(sums[2])
                sums[3] += dw * dw
                self.weight = np.maximum(self.weight - rate * dw / np.sqrt(sums[3]), 0).astype(np.float32)
                sums[4] += float(dz.sum()) ** 2
                self.base -= rate * float(dz.sum()) / np.sqrt(sums[4])
        return self


def _windows(split: list[np.ndarray], ids: np.ndarray, k: int, buffers: np.ndarray) -> np.ndarray:
    """(places, FILTERS): responses of width number k at each place, in the first of two buffers of that shape."""
    first, (resp, more) = sum(WIDTHS[:k]), buffers
    # the mode only spares a copy: no number is out of range
    np.take(split[first], ids, axis=0, out=resp, mode="clip")
    for o in range(1, WIDTHS[k]):
        n = len(ids) - o
        np.take(split[first + o], ids[o:], axis=0, out=more[:n], mode="clip")
        resp[:n] += more[:n]
    return resp


def uses(docs: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """How many documents use each table row."""
    used, slot = np.zeros(ROWS + STEMS, np.int64), np.zeros(ROWS + STEMS, np.int64)
    for d in docs:
        own = rows[d].ravel()
        slot[own] = np.arange(len(own))
        used[own[slot[own] == np.arange(len(own))]] += 1
    return used


def class_weight(y: np.ndarray) -> float:
    """How much a positive document weighs in training."""
    return min(8.0, max(1.0, (y == 0).sum() / max(1, (y == 1).sum())))


def encode(words: list[str], lexicon: Lexicon) -> np.ndarray:
    return np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words))


def pack(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' words, each document followed by PAD times no word, with where each one starts and ends."""
    n = np.array([max(1, len(d)) for d in docs])
    starts = np.concatenate([[0], np.cumsum(n + PAD)[:-1]])
    ids = np.zeros(int((n + PAD).sum()), np.int64)
    for s, d in zip(starts, docs):
        ids[s : s + len(d)] = d
    return ids, starts, starts + n


def best_threshold(positive: np.ndarray, corpus: np.ndarray, least: float = 0.2, even: float = 0.005) -> float:
    """The score from which documents are flagged, for the best F1 in the corpus: between ``best_cut`` and the corpus's next score below."""
    cuts, all_ = np.unique(positive), np.sort(corpus)
    cut = best_cut(positive, cuts, len(all_) - np.searchsorted(all_, cuts), len(all_), least, even)
    below = np.searchsorted(all_, cut)
    return float((cut + (all_[below - 1] if below else 0.0)) / 2)


def best_cut(positive: np.ndarray, cuts: np.ndarray, over: np.ndarray, total: int, least: float = 0.2, even: float = 0.005) -> float:
    """The cut with the best F1 in the corpus.

    ``positive``: held-out scores of documents labelled so; ``cuts``: their different values in order; ``over``: documents of
    the corpus, of ``total``, with at least that score. Between two of them recall is the same and more are flagged, so that no
    other cut can be better. The share of positives over a cut is the recall there, and the share of the corpus over it is what
    would be flagged, so that flagged over recall is the share of cases in the corpus, and more where others are flagged as
    well: its smallest value (over cuts that keep the share ``least`` of the positives) estimates that share. Wrong labels among
    the positives lower recall at every cut alike, and hardly move the best one."""
    recall = (len(positive) - np.searchsorted(np.sort(positive), cuts)) / len(positive)
    # one document more is flagged than was seen: a cut above all of the corpus tells nothing
    flagged = (over + 1) / (total + 1)
    use = recall >= least
    share = (flagged[use] / recall[use]).min()
    f1 = 2 * share * recall / (flagged + share)
    # the highest of the cuts as good as the best: what differs by less, or by one labelled document, is chance
    return float(cuts[np.flatnonzero(f1 >= f1.max() - max(even, 1 / len(positive)))[-1]])


def thresholds(scores: DataFrame, positive: dict[str, np.ndarray]) -> dict[str, float]:
    """``best_threshold`` of each language's positives (of "": of all) in all of its rows of ``scores`` (lang, score), which are
    counted between the cuts where they are and never gathered."""
    cuts = {name: np.unique(x) for name, x in positive.items()}
    told = scores.sparkSession.sparkContext.broadcast(cuts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {name: np.zeros(len(x) + 1, np.int64) for name, x in told.value.items()}
        for b in batches:
            lang, score = np.array([x or "" for x in b.column(0).to_pylist()], object), b.column(1).to_numpy()
            for name, n in seen.items():
                own = score if name == "" else score[lang == name]
                n += np.bincount(np.searchsorted(told.value[name], own, side="right"), minlength=len(n))
        for name, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["name", "at", "n"])

    some = scores.select("lang", "score").mapInArrow(count, "name string, at long, n long").groupBy("name", "at").agg(F.sum("n").alias("n")).collect()
    best = {}
    for name, x in cuts.items():
        n = np.zeros(len(x) + 1, np.int64)
        for r in some:
            if r.name == name:
                n[r.at] = r.n
        if n.sum():
            best[name] = best_cut(positive[name], x, n[::-1].cumsum()[::-1][1:], int(n.sum()))
    if not best:
        return {}
    own = [F.max(F.when((F.col("score") < cut) & (F.lit(name == "") | (F.coalesce("lang", F.lit("")) == name)), F.col("score"))).alias(f"b{k}") for k, (name, cut) in enumerate(best.items())]
    below = scores.agg(*own).first()
    return {name: (cut + (below[k] or 0.0)) / 2 for k, (name, cut) in enumerate(best.items())}


@dataclass
class Sample:
    """All labelled documents as word numbers, with the table rows of each word."""

    docs: list[np.ndarray]
    rows: np.ndarray
    y: np.ndarray
    epochs: int
    seed: int

    def fit(self, use: np.ndarray, turn: int, epochs: int) -> Classifier:
        return Classifier.fresh(self.seed + turn).fit([self.docs[i] for i in use], self.rows, self.y[use], epochs, self.seed + turn)


def _fitter(shared, jobs):
    """Numbers of jobs -> results: a job is (documents to learn from, documents to judge or none for the model itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, todo = shared.value, jobs.value
        for b in batches:
            for job in b.column(0).to_pylist():
                use, judge = todo[job]
                model = sample.fit(use, job, sample.epochs if judge is not None else sample.epochs + 2)
                out = model if judge is None else model.scores([sample.docs[i] for i in judge], sample.rows)
                yield pa.RecordBatch.from_arrays([pa.array([job], pa.int64()), pa.array([pickle.dumps(out)], pa.binary())], ["job", "out"])

    return run


def _fitted(spark: SparkSession, shared, jobs: list[tuple[np.ndarray, np.ndarray | None]]) -> list:
    """Every job in a task of its own."""
    told = spark.sparkContext.broadcast(jobs)
    got = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(_fitter(shared, told), "job long, out binary").collect()
    return [pickle.loads(bytes(r.out)) for r in sorted(got, key=lambda r: r.job)]


def train(spark: SparkSession, docs: list[np.ndarray], rows: np.ndarray, y: np.ndarray, folds: tuple[int, int] = (3, 5), epochs: int = 6, seed: int = 5) -> tuple[Classifier, np.ndarray]:
    """The classifier, and the held-out score of each document.

    Labels are cleaned: models of the other folds judge each one, and those they contradict clearly are left out of training
    (not of calibration). Each fit is a task of its own."""
    shared = spark.sparkContext.broadcast(Sample(docs, rows, y, epochs, seed))
    keep, held = np.ones(len(docs), bool), np.zeros(len(docs))
    # the second turn's judges have learnt without the labels that the first one's contradict; they are more, so that each
    # learns from nearly as much as the classifier and finds nearly as many
    for parts in folds:
        fold = np.random.default_rng(seed).integers(0, parts, len(docs))
        jobs = [(np.flatnonzero((fold != f) & keep), np.flatnonzero(fold == f)) for f in range(parts)]
        held = np.zeros(len(docs))
        for (_, own), scores in zip(jobs, _fitted(spark, shared, jobs)):
            held[own] = scores
        keep = ~((y == 1) & (held < 0.2)) & ~((y == 0) & (held > 0.8))
    if y[keep].sum() == 0 or y[keep].all():
        keep[:] = True
    model = _fitted(spark, shared, [(np.flatnonzero(keep), None)])[0]
    # training weighed the classes alike: back to odds as among the labels
    shift = np.log(class_weight(y[keep]))
    model.base -= shift
    odds = np.log(np.clip(held, 1e-9, 1) / np.clip(1 - held, 1e-9, 1)) - shift
    return model, 1 / (1 + np.exp(-odds))


def marked(documents: DataFrame, labels: DataFrame, max_labels: int | None = None, max_bytes: int | None = None, seed: int = 23) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text, lang, y)`` of every labelled document, and the ids with a label. If ``max_labels`` or ``max_bytes`` are
    given, of at most so many documents or so many bytes together, drawn by hash, half of either label; the last drawn go where
    the texts are longer.

    A document's label is what most of its raters say; those without a label, or equally split, are left out."""
    v = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("m")).where("m <> 0.5").select("doc_id", (F.col("m") > 0.5).cast("int").alias("y"))
    some = stage(v.withColumn("o", F.xxhash64("doc_id", F.lit(seed))), "abuse-votes")
    if max_labels is not None:
        some = stage(some.where("y = 1").orderBy("o", "doc_id").limit(max_labels // 2).unionByName(some.where("y = 0").orderBy("o", "doc_id").limit(max_labels // 2)), "abuse-labels")
    found = documents.select("doc_id", "text", "lang").where("text is not null").join(small_side(some), "doc_id").dropDuplicates(["doc_id"])
    if max_bytes is not None:
        ahead = Window.partitionBy("y").orderBy("o", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("b", F.sum(F.octet_length("text")).over(ahead)).where(F.col("b") <= max_bytes // 2)
    return found.select("doc_id", "text", "lang", "y"), some.select("doc_id")


def labelled(documents: DataFrame, labels: DataFrame, max_labels: int | None = None, max_bytes: int | None = None) -> tuple[list[str], np.ndarray, list[str], DataFrame]:
    """Texts, labels, languages of ``marked`` documents, and (as a table) the ids with a label."""
    found, ids = marked(documents, labels, max_labels, max_bytes)
    rows = found.orderBy("doc_id").collect()
    return [r.text for r in rows], np.array([r.y for r in rows], np.int64), [r.lang or "" for r in rows], ids


#: labelled documents as words
WORDS = "doc_id long, lang string, y int, words binary"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, lang, y -> doc_id, lang, y, words: both table rows of each word as one whole number."""
    lexicon = Lexicon()
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            if len(lexicon.rows) > 100_000:
                lexicon = Lexicon()
            part = b.slice(lo, 1000)
            docs = [encode(plain_words(t), lexicon) for t in part.column(1).to_pylist()]
            rows = np.array(lexicon.rows)
            code = (rows[:, 0] * STEMS + rows[:, 1] - ROWS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([code[d].tobytes() for d in docs], pa.binary())], ["doc_id", "lang", "y", "words"])


def numbered(codes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Word numbers of documents, and the table rows of each word."""
    known = np.zeros(0, np.int32)
    for lo in range(0, len(codes), 5000):
        known = np.unique(np.concatenate([known, *codes[lo : lo + 5000]]))
    rows = np.concatenate([[[-1, -1]], np.stack([known // STEMS, ROWS + known % STEMS], 1)])
    return [(np.searchsorted(known, d) + 1).astype(np.int32) for d in codes], rows


def learnt(found: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, list[np.ndarray], np.ndarray]:
    """Ids, languages, labels and word numbers of all ``marked`` documents, by id, and the table rows of each word. Words are
    read where the texts are; the driver holds four bytes a word."""
    return _gathered(found.mapInArrow(_encoded, WORDS))


def _gathered(words: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, list[np.ndarray], np.ndarray]:
    t = words.toArrow()
    order = np.argsort(t["doc_id"].to_numpy(), kind="stable")
    codes, lang = [np.frombuffer(x, np.int32) for x in t["words"].to_pylist()], t["lang"].to_pylist()
    docs, rows = numbered([codes[i] for i in order])
    return t["doc_id"].to_numpy()[order], [lang[i] or "" for i in order], t["y"].to_numpy()[order].astype(np.int64), docs, rows


# ---- labels that are too many for one task ----


def _flat(m: Classifier, sums: list) -> np.ndarray:
    return np.concatenate([np.ravel(x) for x in (*m._state(), m.base, sums[0], *sums[1], *sums[2:])]).astype(np.float32)


def _unflat(flat: np.ndarray) -> tuple[Classifier, list]:
    m = Classifier.fresh(0)
    sums, at, out = m.fresh_sums(), 0, []
    for x in (*m._state(), m.base, sums[0], *sums[1], *sums[2:]):
        n = np.size(x)
        out.append(flat[at : at + n].reshape(np.shape(x)).copy())
        at += n
    k = len(WIDTHS)
    m.table, m.filters, m.bias, m.weight, m.base = out[0], out[1 : k + 1], out[k + 1], out[k + 2], float(out[k + 3])
    return m, [out[k + 4], out[k + 5 : 2 * k + 5], out[2 * k + 5], out[2 * k + 6], float(out[2 * k + 7])]


def _fold(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts


def _each_shard(table: DataFrame, work, parts: int) -> dict[int, tuple[float, np.ndarray]]:
    """job -> (sum of n, mean by n of the arrays) of what ``work`` yields of each shard: (job, n, array). Sixteen sums of shards
    a job are made first, so that no task holds many arrays."""
    kind = "job long, part long, n double, out binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, keep, codes = [], [], [], []
        for b in batches:
            for out, column in ((ids, 0), (y, 2), (keep, 5)):
                out += b.column(column).to_pylist()
            codes += [np.frombuffer(x, np.int32) for x in b.column(3).to_pylist()]
        if ids:
            ids, y, keep = np.array(ids, np.int64), np.array(y, np.int64), np.array(keep, bool)
            shard = TaskContext.get().partitionId()
            docs, rows = numbered(codes)
            for job in range(parts):
                use = np.flatnonzero(keep & ((_fold(ids, parts) != job) | (parts == 1)))
                if len(use):
                    n, out = work(job, shard, [docs[i] for i in use], rows, y[use])
                    yield pa.RecordBatch.from_arrays([pa.array([job], pa.int64()), pa.array([shard % 16], pa.int64()), pa.array([float(n)]), pa.array([out.astype(np.float32).tobytes()], pa.binary())], ["job", "part", "n", "out"])

    def mean(t: pa.Table) -> pa.Table:
        n, out = t["n"].to_numpy(), 0.0
        for w, x in zip(n, t["out"]):
            out = out + w / n.sum() * np.frombuffer(x.as_py(), np.float32)
        return pa.table({"job": t["job"][:1], "part": t["part"][:1], "n": pa.array([n.sum()]), "out": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

    some = table.mapInArrow(run, kind).groupBy("job", "part").applyInArrow(mean, kind)
    rows = some.withColumn("part", F.lit(0).cast("long")).groupBy("job", "part").applyInArrow(mean, kind).collect()
    return {r.job: (r.n, np.frombuffer(bytes(r.out), np.float32)) for r in rows}


def train_in_shards(words: DataFrame, folds: tuple[int, int] = (3, 5), epochs: int = 6, seed: int = 5) -> tuple[Classifier, DataFrame]:
    """As ``train``, of any number of documents: each task learns an epoch from its own ones, then all go on from the mean of
    their weights. The second result is ``(doc_id, lang, y, held)``."""
    spark = words.sparkSession
    table = words.withColumns({"held": F.lit(0.0), "keep": F.lit(True)})

    def count(job, shard, docs, rows, y):
        return 1, np.concatenate([uses(docs, rows), [(y == 0).sum(), (y == 1).sum()]])

    for parts in (*folds, 1):
        counts = {job: n * x for job, (n, x) in _each_shard(table, count, parts).items()}
        if parts == 1 and (not counts or 0 in counts[0][-2:]):
            table = table.withColumn("keep", F.lit(True))
            counts = {job: n * x for job, (n, x) in _each_shard(table, count, parts).items()}
        states, ups = {}, {job: min(8.0, max(1.0, float(x[-2] / max(1, x[-1])))) for job, x in counts.items()}
        for job, x in counts.items():
            m = Classifier.fresh(seed + job).begin(np.round(x[:-2]), np.random.default_rng(seed + job))
            states[job] = _flat(m, m.fresh_sums())
        for turn in range(epochs + 2 * (parts == 1)):
            told = spark.sparkContext.broadcast(states)

            def learn(job, shard, docs, rows, y, told=told, turn=turn, ups=ups):
                m, sums = _unflat(told.value[job])
                m.learn(docs, rows, y, 1, np.random.default_rng([seed, job, shard, turn]), sums, ups[job])
                return len(docs), _flat(m, sums)

            states |= {job: x for job, (_, x) in _each_shard(table, learn, parts).items()}
        if parts == 1:
            break
        told = spark.sparkContext.broadcast(states)

        def judge(batches: Iterator[pa.RecordBatch], told=told, parts=parts) -> Iterator[pa.RecordBatch]:
            models = {job: _unflat(x)[0] for job, x in told.value.items()}
            for b in batches:
                docs, rows = numbered([np.frombuffer(x, np.int32) for x in b.column(3).to_pylist()])
                fold, y, held = _fold(b.column(0).to_numpy(), parts), b.column(2).to_numpy(), np.zeros(b.num_rows)
                for job, m in models.items():
                    own = np.flatnonzero(fold == job)
                    held[own] = m.scores([docs[i] for i in own], rows)
                keep = ~((y == 1) & (held < 0.2)) & ~((y == 0) & (held > 0.8))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(held), pa.array(keep)], ["doc_id", "lang", "y", "words", "held", "keep"])

        table = stage(table.mapInArrow(judge, WORDS + ", held double, keep boolean"), "abuse-judged")
    model, shift = _unflat(states[0])[0], float(np.log(ups[0]))
    model.base -= shift
    p = F.least(F.greatest("held", F.lit(1e-9)), F.lit(1 - 1e-9))
    return model, table.select("doc_id", "lang", "y", (1 / (1 + F.exp(shift - F.ln(p / (1 - p))))).alias("held"))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lexicon = model.value, Lexicon()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                if len(lexicon.rows) > 100_000:
                    lexicon = Lexicon()
                part = b.slice(lo, 1000)
                docs = [encode(plain_words(t or ""), lexicon) for t in part.column(3).to_pylist()]
                s = m.scores(docs, np.array(lexicon.rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(s)], ["doc_id", "lang", "source", "score"])

    return run


class AbuseScores:
    """Scores of documents by a classifier trained on their human labels.

    ``documents``: doc_id, text, lang, source; ``labels``: doc_id, toxic (0, 1 or null; several rows of a document are votes).
    Training uses every labelled document, in shards if they hold more than ``gathered`` words (or, if ``max_labels`` or ``max_bytes`` are given, as many, see ``marked``). Every
    document is scored over its whole text, once, and thresholds are set on the held-out scores of the positives and on the
    scores of all documents (of those learnt from the held-out ones), for each language with ``least`` positives and for all
    together. A null or empty text scores as one without words; a null language uses the general threshold; rows with a null
    doc_id are left out; repeated rows come out repeated. Without any label of either kind nothing is flagged.
    """

    KIND = "doc_id long, lang string, source string, score double"

    def __init__(self, documents: DataFrame, labels: DataFrame, max_labels: int | None = None, max_bytes: int | None = None, least: int = 25, gathered: int = 16 << 20):
        spark = documents.sparkSession
        words = stage(marked(documents, labels, max_labels, max_bytes)[0].mapInArrow(_encoded, WORDS), "abuse-words")
        told = words.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0), F.sum(F.octet_length("words") / 4)).first()
        rows = documents.select("doc_id", "lang", "source", "text").where("doc_id is not null")
        own = None
        if told[0] and told[1] and told[2] <= gathered:
            ids, langs, y, docs, known = _gathered(words)
            model, held = train(spark, docs, known, y)
            own = spark.createDataFrame(pa.table({"doc_id": ids, "held": held}))
            langs, held = np.array(langs, object)[y == 1], held[y == 1]
        elif told[0] and told[1]:
            files = max(8, int(told[2] // gathered) + 1)
            model, own = train_in_shards(stage(words.repartition(files, "doc_id"), "abuse-shards"))
            own = stage(own, "abuse-held")
            t = own.where("y = 1").orderBy("doc_id").select("lang", "held").toArrow()
            langs, held = np.array([x or "" for x in t["lang"].to_pylist()], object), t["held"].to_numpy()
        else:
            model = Classifier.fresh(0)
            model.weight[:] = 0
            model.base = -30.0
        scored = stage(rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), self.KIND), "abuse-scores")
        model.thresholds = {"": 1.1}
        if own is not None:
            corpus = scored.join(small_side(own.select("doc_id", "held")), "doc_id", "left").select("lang", F.coalesce("held", "score").alias("score"))
            positive = {name: held[(langs == name) | (name == "")] for name in ["", *sorted(set(langs) - {""})]}
            model.thresholds |= thresholds(corpus, {name: x for name, x in positive.items() if len(x) >= (least if name else 1)})
        self.model = model
        cut = F.lit(model.thresholds[""])
        for name, x in model.thresholds.items():
            if name:
                cut = F.when(F.col("lang") == name, F.lit(x)).otherwise(cut)
        self.scores = scored.withColumn("flagged", F.col("score") >= cut)

    def rates(self) -> DataFrame:
        """Per source (null is a source of its own): documents, flagged ones, their rate, and the mean score."""
        return self.scores.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"), F.avg("score").alias("mean_score"))
