"""Most similar vectors for every vector: inverted file with product-quantised residuals.

Vectors are assigned to coarse centroids; the residual to the centroid is quantised, one byte per subspace. Every distinct
vector is sent to the cells whose centroids lie nearest and, in each, scored against the cell's codes through asymmetric
distance tables (query against codewords). The best of that shortlist are reranked by exact cosine on the stored vectors.
Neighbouring cells form a region; a vector travels once to each region that holds some of its cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.storage import small_side, stage


#: how far a table look-up may fall below the exact similarity before a neighbour at the floor is missed
SLACK = 0.2
#: table scores nearer than this to the k-th best are not taken as ordered
MARGIN = 0.12


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool = False) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = np.empty(len(x), np.int64)
        bias = (c * c).sum(1) / 2
        for lo in range(0, len(x), 8192):
            at[lo : lo + 8192] = (x[lo : lo + 8192] @ c.T - bias).argmax(1)
        n = np.bincount(at, minlength=k)
        s = np.zeros_like(c)
        order = np.argsort(at, kind="stable")
        used = np.flatnonzero(n)
        s[used] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[used])[:-1]]), axis=0)
        c = np.where(n[:, None] > 0, s / np.maximum(1, n)[:, None], c)
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _home(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector."""
    return np.concatenate([(x[lo : lo + 4096] @ c.T).argmax(1) for lo in range(0, len(x), 4096)])


def _cells(x: np.ndarray, k: int, rounds: int, seed: int, flat: int = 2048) -> np.ndarray:
    """About k spherical centroids; many of them by groups of their own, so that time grows with the root of their number."""
    if k <= flat:
        return _kmeans(x, k, rounds, seed, spherical=True)
    top = _kmeans(x, math.ceil(math.sqrt(k)), rounds, seed, spherical=True)
    group = _home(x, top)
    parts = [x[group == g] for g in range(len(top))]
    return np.concatenate([_kmeans(p, max(1, round(k * len(p) / len(x))), rounds, seed + g, spherical=True) for g, p in enumerate(parts) if len(p)])


def _merged(c: np.ndarray, x: np.ndarray, alike: float = 0.85) -> np.ndarray:
    """Centroids so alike that one crowd of vectors was cut between them become one, the largest first.

    A crowd then has one cell, which is searched in blocks, instead of more cells than a query probes."""
    n = np.bincount(_home(x, c), minlength=len(c))
    left, out = np.ones(len(c), bool), []
    for i in np.argsort(-n, kind="stable"):
        if left[i]:
            own = left & (c @ c[i] >= alike)
            own[i] = True
            left &= ~own
            mean = (c[own] * np.maximum(n[own], 1)[:, None]).sum(0)
            out.append(mean / np.linalg.norm(mean))
    return np.array(out, np.float32)


@dataclass
class IvfPq:
    """Centroids (cells, dims), codebooks (subspaces, codewords, dims / subspaces), and the region of each cell."""

    centroids: np.ndarray
    books: np.ndarray
    regions: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, cells: int, subspaces: int, seed: int = 7, regions: int = 1) -> IvfPq:
        x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
        cent = _merged(_cells(x, cells, 6, seed), x)
        rest = x - cent[_home(x, cent)]
        w = x.shape[1] // subspaces
        pick = rest[np.random.default_rng(seed).permutation(len(rest))[:16384]]
        books = [_kmeans(pick[:, m * w : (m + 1) * w].copy(), 256, 6, seed + m) for m in range(subspaces)]
        near = _kmeans(cent, regions, 6, seed, spherical=True)
        return IvfPq(cent, np.stack([np.pad(b, ((0, 256 - len(b)), (0, 0)), mode="edge") for b in books]), (cent @ near.T).argmax(1))

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """(rows, subspaces) uint8 codes of the residuals."""
        r = x - self.centroids[cell]
        m, _, w = self.books.shape
        out = np.empty((len(x), m), np.uint8)
        for j in range(m):
            b = self.books[j]
            out[:, j] = (r[:, j * w : (j + 1) * w] @ b.T - (b * b).sum(1) / 2).argmax(1)
        return out

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """(codes, queries) approximate inner products: query with centroid, plus one table look-up per subspace."""
        m, _, w = self.books.shape
        total = np.tile((q @ self.centroids[cell]).astype(np.float32), (len(codes), 1))
        for j in range(m):
            table = self.books[j] @ q[:, j * w : (j + 1) * w].T  # codewords x queries
            total += table[codes[:, j]]
        return total


def _usable(dims: int):
    """id, ver, vector -> unit vectors as bytes; other rows are left out. Spark's arrays come as Arrow lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            n = pa.compute.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(n == dims)
            if not len(at):
                continue
            t = b.take(pa.array(at))
            x = t.column(2).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            top = np.abs(x).max(1, initial=0)
            ok = np.isfinite(x).all(1) & (top > 0)
            x = x[ok] / top[ok][:, None]
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([t.column(0).take(keep), t.column(1).take(keep), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "ver", "v"])

    return run


def _matrix(column) -> np.ndarray:
    """Equal-length binary values as a float32 matrix."""
    vals = column.to_pylist()
    return np.frombuffer(b"".join(vals), np.float32).reshape(len(vals), -1)


def probes_for(index: IvfPq, sample: np.ndarray, k: int, recall: float, asked: int = 1000) -> int:
    """How many cells a vector must ask for this share of its k most similar vectors, by brute force in the sample.

    In a sample neighbours lie farther off than among all vectors, so that the figure is rather too large."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    home = _home(x, index.centroids)
    places = []
    pick = np.random.default_rng(11).permutation(len(x))[:asked]
    for lo in range(0, len(pick), 250):
        q = pick[lo : lo + 250]
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -2
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        c = x[q] @ index.centroids.T
        places.append((c[:, None, :] > np.take_along_axis(c, home[near], 1)[:, :, None]).sum(2).ravel())
    places = np.sort(np.concatenate(places))
    return int(places[math.ceil(recall * len(places)) - 1]) + 1


def _probes(index, probes: int, coded: bool = True):
    """Every vector to the regions of its ``probes`` nearest cells; the nearest cell is its home, where it is stored.

    ``cut`` is the similarity to the farthest centroid asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x = _matrix(part.column(1))
                s = x @ ix.centroids.T
                p = min(probes, s.shape[1])
                near = np.argpartition(-s, p - 1, axis=1)[:, :p] if p < s.shape[1] else np.tile(np.arange(p), (len(x), 1))
                cell = s.argmax(1)
                region = np.sort(ix.regions[near], axis=1)
                first = np.ones(region.shape, bool)
                first[:, 1:] = region[:, 1:] != region[:, :-1]
                rows = np.nonzero(first)[0]
                region = region[first]
                cut = np.take_along_axis(s, near, 1).min(1)
                at = pa.array(rows)
                home = region == ix.regions[cell][rows]
                # a vector is encoded once, where it is stored
                codes = ix.encode(x, cell) if coded else None
                held = pa.array([codes[r].tobytes() if h else None for r, h in zip(rows, home)] if coded else [None] * len(rows), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(region.astype(np.int32)), pa.array(home), pa.array(cell[rows].astype(np.int32)), pa.array(cut[rows]), part.column(0).take(at), part.column(1).take(at), held], ["region", "home", "cell", "cut", "num", "v", "codes"])

    return run


def _crowded(x, rows, have, s, least, k, floor, qi, xi, sims):
    """Exact similarities of these queries with every stored vector whose table score reaches ``least``; the k best are added."""
    exact = x[rows].astype(np.float64) @ x[have].T.astype(np.float64)
    exact[(s.T < least[:, None]) | (have[None, :] == rows[:, None]) | (exact < floor)] = -2
    top = np.argpartition(-exact, min(k, len(have)) - 1, axis=1)[:, :k]
    e = np.take_along_axis(exact, top, 1)
    ok = e > -1.5
    return [*qi, np.repeat(rows, top.shape[1]).reshape(top.shape)[ok]], [*xi, have[top][ok]], [*sims, e[ok]]


def _search_cell(ix, x, have, codes, ask, cell, k, shortlist, floor, qi, xi, sims):
    """Adds the k best of the vectors ``have``, all of one cell and with these codes, for each of the queries ``ask``."""
    for lo in range(0, len(ask), 256):
        rows = ask[lo : lo + 256]
        s = ix.scores(x[rows], cell, codes)
        near = (s >= floor - SLACK).any(0)  # queries with nothing near the floor need no reranking
        if not near.any():
            continue
        rows, s = rows[near], s[:, near]
        r = min(shortlist, len(have))
        best = np.argpartition(-s, r - 1, axis=0)[:r].T if r < len(have) else np.tile(np.arange(len(have)), (len(rows), 1))
        kth = -np.partition(-s, min(k, len(have)) - 1, axis=0)[min(k, len(have)) - 1]
        crowd = (s >= np.maximum(kth - MARGIN, floor - SLACK)).sum(0) > r
        if crowd.any():  # more lie too near to be told apart by tables than the shortlist holds: rerank all of these
            qi, xi, sims = _crowded(x, rows[crowd], have, s[:, crowd], np.maximum(kth - MARGIN, floor - SLACK)[crowd], k, floor, qi, xi, sims)
            rows, best = rows[~crowd], best[~crowd]
            if not len(rows):
                continue
        exact = np.einsum("qd,qrd->qr", x[rows].astype(np.float64), x[have[best]].astype(np.float64))
        exact[have[best] == rows[:, None]] = -2
        exact = np.where(exact >= floor, exact, -2)
        n = min(k, r)
        top = np.argpartition(-exact, n - 1, axis=1)[:, :n] if n < r else np.tile(np.arange(r), (len(rows), 1))
        e = np.take_along_axis(exact, top, 1)
        ok = e > -1.5
        qi = [*qi, np.repeat(rows, top.shape[1]).reshape(top.shape)[ok]]
        xi = [*xi, have[np.take_along_axis(best, top, 1)][ok]]
        sims = [*sims, e[ok]]
    return qi, xi, sims


def _search(index, k: int, shortlist: int, floor: float):
    """The k best of one block of a region for each vector that asks there, over those of its cells that lie in the region."""

    def run(t: pa.Table) -> pa.Table:
        ix = index.value
        region, stored, asks = t.column("region")[0].as_py(), t.column("stored").to_numpy(), t.column("asks").to_numpy()
        num, home, cut = t.column("num").to_numpy(), t.column("cell").to_numpy(), t.column("cut").to_numpy()
        x = _matrix(t.column("v"))
        have, ask = np.flatnonzero(stored), np.flatnonzero(asks)
        have = have[np.argsort(home[have], kind="stable")]
        codes = np.frombuffer(b"".join(t.column("codes").take(pa.array(have)).to_pylist()), np.uint8).reshape(len(have), -1) if len(have) else None
        qi, xi, sims = [], [], []
        for cell in np.flatnonzero(ix.regions == region) if len(ask) else ():
            at = slice(*np.searchsorted(home[have], [cell, cell + 1]))
            own = have[at]
            if len(own):
                # 1e-5: the same product may round otherwise here than where the cells were chosen
                who = ask[x[ask] @ ix.centroids[cell] >= cut[ask] - 1e-5]
                a, b, c = _search_cell(ix, x, own, codes[at], who, cell, k, shortlist, floor, [], [], [])
                qi, xi, sims = qi + a, xi + b, sims + c
        q, y, s = (np.concatenate(z) if z else np.zeros(0, t) for z, t in ((qi, np.int64), (xi, np.int64), (sims, np.float64)))
        order = np.lexsort((num[y], -s, q))
        keep = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
        return pa.table({"a": pa.array(num[q[keep]]), "b": pa.array(num[y[keep]]), "similarity": pa.array(s[keep])})

    return run


class SimilarVectors:
    """The ``k`` most similar vectors of every usable vector.

    ``rows`` has columns ``id`` (string), ``vector`` (array of numbers) and ``ver``; of several rows of one id the usable one
    with the largest ``ver`` counts. Usable are vectors of exactly ``dims`` finite numbers, not all zero; others, and rows
    with a null id, take no part. Equal vectors are indexed once. Similarity is the cosine.

    ``min_similarity`` leaves out neighbours below it (-1: none). The index has about twice the root of the number of
    distinct vectors as cells, and is fitted on ``sample_rows`` vectors, or ten a cell if these are more, drawn by hash of
    the id; every vector is indexed and searched. ``probes``: cells asked for each vector, by default (at
    least 4) as many as ``recall`` takes, measured on the sample.
    """

    def __init__(self, rows: DataFrame, k: int = 5, dims: int = 64, min_similarity: float = -1.0, probes: int | None = None, shortlist: int = 40, subspaces: int = 16, sample_rows: int = 40_000, cells: int | None = None, block_rows: int = 32_000, recall: float = 0.9):
        self.k, self.dims, self.floor, self.shortlist, self.block_rows = k, dims, min_similarity, shortlist, block_rows
        spark = rows.sparkSession
        raw = rows.select("id", "ver", "vector").where("id is not null and vector is not null")
        raw = raw.mapInArrow(_usable(dims), "id string, ver timestamp, v binary")
        w = Window.partitionBy("id").orderBy(F.desc_nulls_last("ver"), "v")
        self.all = stage(raw.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "v", F.monotonically_increasing_id().alias("num")), "vectors")
        # vectors held by several ids: map-side counts first, then the ids of those alone
        many = stage(self.all.groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("rep")).where("copies > 1"), "vectors-equal")
        held = self.all.join(small_side(many), "v")
        first = Window.partitionBy("rep").orderBy("id")
        self.copies = stage(held.select("rep", "id", "copies"), "vectors-copies")
        #: of each class of equal vectors the k + 1 smallest ids, ranked (pre-limited before the shuffle by Spark)
        self.heads = stage(self.copies.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1), "vectors-heads")
        self.distinct = self.all.join(small_side(self.copies.where("id <> rep").select("id")), "id", "left_anti")
        self.count = self.distinct.count()
        cells = cells or max(1, int(2 * math.sqrt(self.count)))
        wanted = max(sample_rows, 10 * cells)
        # drawn by hash, with a margin, and cut in the order of the hash: the same vectors in every run
        part = min(1.0, 1.1 * wanted / max(1, self.count) + 1e-4)
        drawn = self.distinct.withColumn("o", F.xxhash64("id", F.lit(17))).where(F.pmod("o", F.lit(1_000_000)) < int(part * 1_000_000))
        sample = [bytes(r.v) for r in drawn.orderBy("o", "id").limit(wanted).select("v").collect()]
        if sample:
            x = np.frombuffer(b"".join(sample), np.float32).reshape(-1, dims)
            cells = min(cells, len(x))
            # regions of half a block, so that few are cut
            index = IvfPq.fit(x, cells, subspaces, regions=math.ceil(2 * self.count / block_rows))
            self.index = spark.sparkContext.broadcast(index)
            self.probes = probes or max(4, probes_for(index, x, k, recall))

    def _edges(self) -> DataFrame:
        """(a, b, similarity) between distinct vectors by number: b among the k best found for a within one block of one region."""
        kinds = "region int, home boolean, cell int, cut float, num long, v binary, codes binary"
        home = self.distinct.select("num", "v").mapInArrow(_probes(self.index, 1, False), kinds)
        blocks = F.ceil(F.col("count") / self.block_rows)
        parts = F.greatest(blocks, F.ceil(F.col("count") * self.probes / (16 * self.block_rows)))
        size = home.groupBy("region").count().select("region", blocks.cast("int").alias("nb"), parts.cast("int").alias("np"))
        sent = self.distinct.select("num", "v").mapInArrow(_probes(self.index, self.probes), kinds)
        # size: a row for each region. A region of many vectors is cut into nb blocks, and its queries into np parts
        cut = sent.join(F.broadcast(size), "region").withColumn("mine", F.pmod(F.xxhash64("num"), F.col("nb")).cast("int")).withColumn("asking", F.pmod(F.xxhash64("num", F.lit(3)), F.col("np")).cast("int"))
        as_stored = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("np") - 1), lambda p: F.struct(F.col("mine").alias("block"), p.alias("part"), F.lit(True).alias("stored"), (p == F.col("asking")).alias("asks")))).otherwise(F.array().cast("array<struct<block:int,part:int,stored:boolean,asks:boolean>>"))
        elsewhere = F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: ~F.col("home") | (b != F.col("mine")))
        as_query = F.transform(elsewhere, lambda b: F.struct(b.alias("block"), F.col("asking").alias("part"), F.lit(False).alias("stored"), F.lit(True).alias("asks")))
        rows = cut.select("region", "cell", "cut", "num", "v", "codes", F.explode(F.concat(as_stored, as_query)).alias("r")).select("region", "cell", "cut", "r.*", "num", "v", F.when(F.col("r.stored"), F.col("codes")).alias("codes"))
        return rows.groupBy("region", "block", "part").applyInArrow(_search(self.index, self.k, self.shortlist, self.floor), "a long, b long, similarity double")

    def neighbours(self) -> DataFrame:
        """``(id, neighbour, similarity, rank)``, best first, equal similarities by id. No usable vector: no rows."""
        k = self.k
        if self.count:
            nearest = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
            found = stage(self._edges().withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).drop("n"), "vectors-edges")
            both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
            both = both.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k)
            names = small_side(self.distinct.select("num", "id"))
            both = both.join(names.select(F.col("num").alias("b"), F.col("id").alias("to")), "b").join(names.select(F.col("num").alias("a"), "id"), "a")
            both = both.select(F.col("id").alias("a"), F.col("to").alias("b"), "similarity")
        else:
            both = self.distinct.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity")).where("false")
        heads = small_side(self.heads.select(F.col("rep").alias("b"), F.col("id").alias("other")))
        options = both.join(heads, "b", "left").select("a", F.coalesce("other", "b").alias("other"), "similarity")
        options = options.unionByName(self.heads.select(F.col("rep").alias("a"), F.col("id").alias("other"), F.lit(1.0).alias("similarity")))
        place = Window.partitionBy("a").orderBy(F.desc("similarity"), "other")
        best = options.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1)
        lists = best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("n", "other", "similarity"))).alias("best"))
        lists = stage(lists, "vectors-lists")
        shared = self.copies.select(F.col("rep").alias("a"), "id").join(lists, "a").select("id", "best")
        alone = lists.join(small_side(self.copies.select(F.col("rep").alias("a")).distinct()), "a", "left_anti").select(F.col("a").alias("id"), "best")
        out = shared.unionByName(alone).select("id", F.posexplode(F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k)).alias("pos", "x"))
        return out.select("id", F.col("x.other").alias("neighbour"), "x.similarity", (F.col("pos") + 1).alias("rank"))
