"""Near-duplicate texts by a MinHash LSH forest with exact verification.

Each text's distinct word shingles give ``trees`` sequences of MinHashes, one packed into 64 bits each, so that rows sorted
by it stand in the order of the tree's trie and texts under one trie node form a run. The walk matches the longest prefix
that still finds ``first_recall`` of the pairs at exactly the threshold; candidates are verified on their whole sets of
shingles. As long as a verified pair is so dissimilar that prefixes of this length find less than ``target_recall`` of its
like, prefixes are shortened by one and the forest is walked again. Equal shingle sets are collapsed before the forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.words import WordHashes, shingles
from papyra.operators.components import connected_components
from papyra.storage import small_side, stage, unstage

#: MinHashes a tree keeps at most: 8 bits of each are left then
DEEPEST = 8


def found_share(similarity: float, depth: int, trees: int) -> float:
    """The share of pairs of this similarity that agree on ``depth`` MinHashes in at least one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float, trees: int, recall: float, deepest: int = DEEPEST) -> int:
    """Longest prefix that finds this share of the pairs at ``threshold``; at least 1."""
    depth = deepest
    while depth > 1 and found_share(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240131)
    return r.integers(1, 2**32, n, np.uint64).astype(np.uint32) | np.uint32(1), r.integers(0, 2**32, n, np.uint64).astype(np.uint32)


def forest_keys(flat: np.ndarray, starts: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """(texts, trees) uint64: the first ``depth`` MinHashes of each tree, 64 / depth bits of each, first one highest."""
    a, b = _coefficients(trees * DEEPEST)
    bits = np.uint64(64 // depth)
    x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    keys = np.zeros((len(starts), trees), np.uint64)
    v = np.empty_like(x)
    for t in range(trees):
        for d in range(depth):
            j = t * DEEPEST + d
            np.multiply(x, a[j], out=v)
            np.add(v, b[j], out=v)
            low = np.minimum.reduceat(v, starts).astype(np.uint64)
            # a minimum's leading bits are mostly 0, and the low ones of a product are weak: mix before cutting
            low = (low * np.uint64(0x9E3779B97F4A7C15)) >> (np.uint64(64) - bits)
            keys[:, t] = (keys[:, t] << bits) | low
    return keys


def _prints(flat: np.ndarray, starts: np.ndarray) -> list[bytes]:
    ends = np.append(starts[1:], len(flat))
    return [xxhash.xxh128_digest(flat[s:e].tobytes()) for s, e in zip(starts, ends)]


def _signer(width: int, min_words: int, trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            for lo in range(0, b.num_rows, 4000):
                part = b.slice(lo, 4000)
                keep, flat, starts = shingles(part.column(3).to_pylist(), cache, width, min_words)
                if not len(keep):
                    continue
                keys = forest_keys(flat, starts, trees, depth)
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), pa.array(_prints(flat, starts), pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())],
                    ["kind", "id", "ver", "fp", "keys"],
                )

    return run


def _sets(width: int, min_words: int):
    """(num, kind, id, fp, text) -> the sets of shingle hashes of the texts whose print is ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            for lo in range(0, b.num_rows, 4000):
                part = b.slice(lo, 4000)
                keep, flat, starts = shingles(part.column(4).to_pylist(), cache, width, min_words)
                if not len(keep):
                    continue
                wanted = part.column(3).take(pa.array(keep)).to_pylist()
                same = np.array([p == w for p, w in zip(_prints(flat, starts), wanted)])
                ends = np.append(starts[1:], len(flat))
                at = pa.array(keep[same])
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((ends - starts)[same])]), pa.int32()), pa.array(flat[np.repeat(same, ends - starts)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), sets], ["num", "kind", "id", "s"])

    return run


def _exploder(depth: int, prefix: int):
    """(num, kind, keys) -> one row for each tree: its first ``prefix`` MinHashes, and the text's number."""
    mask = np.uint64((2**64 - 1) ^ (2 ** ((64 // depth) * (depth - prefix)) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                kind = b.column(1).to_pylist()
                keys = np.stack([np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]) & mask
                # trees never meet, and kinds neither: a constant for both is added to the bits, which leaves runs as they are
                salt = {k: np.array([xxhash.xxh64_intdigest(f"{t} {k}") for t in range(keys.shape[1])], np.uint64) for k in set(kind)}
                keys = keys ^ np.stack([salt[k] for k in kind])
                num = np.repeat(b.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(num)], ["key", "h"])

    return run


def _pairs_of_runs(most: int):
    """Pairs of the runs of equal keys in sorted rows; a run beyond ``most`` comes out as its rows with a number, for blocks."""

    def emit(key: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        key, h = key[new], h[new]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(at, len(key)))
        small = n <= most
        a, b = [], []
        for size in np.unique(n[small]):
            if size > 1:
                rows = at[n == size][:, None] + np.arange(size)
                i, j = np.triu_indices(size, 1)
                a.append(h[rows[:, i]].ravel())
                b.append(h[rows[:, j]].ravel())
        hot = np.repeat(~small, n)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        nulls = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), nulls], ["a", "b", "hot"])
        if hot.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[hot]), pa.nulls(int(hot.sum()), pa.int64()), pa.array(key[hot])], ["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, in_hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            h = np.concatenate([h, batch.column(1).to_numpy(zero_copy_only=False)])
            if in_hot is not None:  # the run goes on: its rows stream out as they come
                n = int(np.searchsorted(key, in_hot, "right"))
                yield pa.RecordBatch.from_arrays([pa.array(h[:n]), pa.nulls(n, pa.int64()), pa.array(key[:n])], ["a", "b", "hot"])
                key, h = key[n:], h[n:]
                in_hot = None if len(key) else in_hot
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            if len(np.unique(h[last:])) > most:
                in_hot, last = key[-1], len(key)
            yield from emit(key[:last], h[:last])
            key, h = key[last:], h[last:]
        yield from emit(key, h)

    return run


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / max(1, len(a) + len(b) - both)


def _verify_block(threshold: float, columns: int = 1 << 22):
    """All pairs of two blocks of one oversized trie node, by counting the shingles that rows share."""

    def run(t: pa.Table) -> pa.Table:
        sets = t.column("s").combine_chunks()
        size = pa.compute.list_value_length(sets).to_numpy(zero_copy_only=False)
        n = len(size)
        row = np.repeat(np.arange(n), size)
        gram, inverse, count = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        use = count[inverse] > 1
        row, col = row[use], shared[inverse[use]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((n, n), np.float32)
        total, step = int(shared[-1]) + 1 if len(shared) else 0, max(1, columns // max(1, n))
        for lo in range(0, total, step):
            a, b = np.searchsorted(col, [lo, lo + step])
            m = np.zeros((n, min(step, total - lo)), np.float32)
            m[row[a:b], col[a:b] - lo] = 1
            both += m @ m.T
        sim = both / np.maximum(1, size[:, None] + size[None, :] - both)
        blk = t.column("blk").to_numpy()
        i, j = np.nonzero(np.triu(sim.astype(np.float64) >= threshold - 1e-6, 1))
        if t.column("bi")[0] != t.column("bj")[0]:
            i, j = (x[blk[i] != blk[j]] for x in (i, j))
        h = t.column("h").to_numpy()
        return pa.table({"a": pa.array(np.minimum(h[i], h[j])), "b": pa.array(np.maximum(h[i], h[j]))})

    return run


class NearDuplicates:
    """Classes of equal shingle sets and the links between them.

    ``texts`` has columns ``kind, id, text, ver``: only texts of one kind are compared; of several rows of one id the
    largest ``ver`` counts. Rows with null kind, id or text, and texts of fewer than ``min_words`` or ``width`` words, take
    no part. Whole texts are used, however long. An empty table gives no classes and no links. Texts travel under numbers
    given to them once, so that no two can be taken for each other.
    """

    def __init__(self, texts: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = 1, trees: int = 48, target_recall: float = 0.99, first_recall: float = 0.9, node_rows: int = 64, block_rows: int = 200, crowd_part: int = 128, crowd_rows: int = 40):
        self.texts, self.threshold, self.width, self.min_words = texts.select("kind", "id", "text", "ver"), threshold, width, min_words
        self.trees, self.target_recall, self.node_rows, self.block_rows = trees, target_recall, node_rows, block_rows
        self.crowd_part, self.crowd_rows = crowd_part, crowd_rows
        self.depth = prefix_depth(threshold, trees, first_recall)
        usable = self.texts.where("kind is not null and id is not null and text is not null")
        signed = usable.select("kind", "id", "ver", "text").mapInArrow(_signer(width, min_words, trees, self.depth), "kind string, id string, ver timestamp, fp binary, keys binary")
        self.signed = stage(signed.withColumn("num", F.monotonically_increasing_id()), "neardup-signed")
        now = self.signed.groupBy("kind", "id").agg(F.max(F.struct("ver", "fp", "num")).alias("x"), F.count("*").alias("deliveries")).select("kind", "id", "x.fp", "x.num", "deliveries")
        classes = now.groupBy("kind", "fp").agg(F.min(F.struct("id", "num")).alias("r"), F.count("*").alias("copies")).select("kind", "fp", F.col("r.id").alias("rep"), F.col("r.num").alias("rep_num"), "copies")
        #: every id with its class: the smallest id with the same set of shingles
        self.members = stage(now.join(classes, ["kind", "fp"]).select("kind", "id", "num", "rep", "rep_num", "copies", "deliveries"), "neardup-members")
        self._links: DataFrame | None = None

    def links(self) -> DataFrame:
        """``(kind, a, b, similarity)``, a < b: every found pair of class representatives at or over the threshold."""
        if self._links is not None:
            return self._links
        again = self.members.where("deliveries > 1").select("kind", "id", F.col("num").alias("now"))
        stale = self.signed.select("kind", "id", "num").join(small_side(again), ["kind", "id"]).where("num <> now").select("num")
        copies = self.members.where("num <> rep_num").select("num")
        out = stage(stale.unionByName(copies), "neardup-left-out")
        rows = self.signed.select("num", "kind", "keys").join(small_side(out), "num", "left_anti").select("num", "kind", "keys")
        found, tried = None, None
        for prefix in range(self.depth, 0, -1):
            keyed = rows.mapInArrow(_exploder(self.depth, prefix), "key long, h long")
            crowded = self._crowded(rows, prefix)
            cold = keyed if crowded is None else keyed.join(crowded, "key", "left_anti").select("key", "h")
            run = cold.repartition("key").sortWithinPartitions("key", "h").mapInArrow(_pairs_of_runs(self.node_rows), "a long, b long, hot long")
            if crowded is not None:
                run = run.unionByName(keyed.join(crowded, "key", "left_semi").select(F.col("h").alias("a"), F.lit(None).cast("long").alias("b"), F.col("key").alias("hot")))
            scanned = stage(run, "neardup-candidates")
            pairs = scanned.where("hot is null").select("a", "b").distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = stage(pairs, "neardup-pairs")
            tried = pairs if tried is None else tried.unionByName(pairs)
            hot = scanned.where("hot is not null").select(F.col("hot").alias("key"), F.col("a").alias("h")).distinct()
            fresh = stage(self._verified(pairs, hot, found), "neardup-found")
            unstage(scanned)
            found = fresh if found is None else stage(found.unionByName(fresh), "neardup-found")
            least = found.agg(F.min("similarity")).first()[0]
            if least is None or found_share(least, prefix, self.trees) >= self.target_recall:
                break
        self._links = found
        return found

    def _crowded(self, rows: DataFrame, prefix: int) -> DataFrame | None:
        """Keys of nodes that hold so many texts that their rows would fill one task, told from one text in ``crowd_part``.

        Their rows go to the blocks at once. A node that isn't told is met in order like any other, so that pairs don't
        depend on it. At most one key for each ``crowd_rows`` rows of the sample."""
        some = rows.where(F.pmod(F.xxhash64("num"), F.lit(self.crowd_part)) == 0).mapInArrow(_exploder(self.depth, prefix), "key long, h long")
        keys = stage(some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= self.crowd_rows).select("key"), "neardup-crowded")
        return small_side(keys) if keys.limit(1).count() else None

    def _verified(self, pairs: DataFrame, hot: DataFrame, known: DataFrame | None) -> DataFrame:
        """The pairs of numbers whose sets are similar enough, as links. A text is read once, and moves at most once."""
        any_hot = bool(hot.limit(1).count())
        hot = stage(hot, "neardup-hot")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("num")).unionByName(hot.select(F.col("h").alias("num"))).distinct()
        wanted = stage(self.signed.select("num", "kind", "id", "fp").join(small_side(stage(wanted, "neardup-wanted")), "num"), "neardup-named")
        sets = self.texts.join(small_side(wanted), ["kind", "id"]).select("num", "kind", "id", "fp", "text").mapInArrow(_sets(self.width, self.min_words), "num long, kind string, id string, s array<long>")
        # one delivery of several with the same set
        sets = stage(sets.dropDuplicates(["num"]), "neardup-sets")
        if any_hot:
            met = self._blocks(hot, sets.select(F.col("num").alias("h"), "s"))
            pairs = pairs.unionByName(met).distinct()
        one, two = (sets.select(F.col("num").alias(c), F.col("kind").alias("k" + c), F.col("id").alias("i" + c), F.col("s").alias("s" + c)) for c in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        met = pairs.join(one, "a").join(two, "b").withColumn("similarity", both / (F.size("sa") + F.size("sb") - both))
        links = met.where(F.col("similarity") >= self.threshold).select(F.col("ka").alias("kind"), F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity")
        return links if known is None else links.join(known.select("kind", "a", "b"), ["kind", "a", "b"], "left_anti")

    def _blocks(self, hot: DataFrame, sets: DataFrame) -> DataFrame:
        """Oversized trie nodes, cut into blocks by hash; each pair of blocks is one group of at most about two blocks' rows."""
        size = hot.groupBy("key").agg(F.ceil(F.count("*") / self.block_rows).cast("int").alias("nb"))
        rows = hot.join(size, "key").withColumn("blk", F.pmod(F.xxhash64("h"), F.col("nb")).cast("int"))
        rows = rows.select("key", "h", "blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")).select("key", "h", "blk", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"))
        return rows.join(sets, "h").groupBy("key", "bi", "bj").applyInArrow(_verify_block(self.threshold), "a long, b long")

    def pairs(self, expand_copies: int = 1000) -> DataFrame:
        """``(kind, id_a, id_b)``: all linked pairs of ids, copies included.

        A class of more than ``expand_copies`` equal shingle sets comes out as its smallest id against each other one, and
        links to it through that id only, as all its pairs would be quadratic; ``groups()`` has every member in any case,
        and says which classes these are."""
        m = self.members.select("kind", "id", "rep", "copies")
        many = m.where("copies > 1")
        inner = many.where(F.col("copies") <= expand_copies).alias("x").join(many.alias("y"), (F.col("x.kind") == F.col("y.kind")) & (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select("x.kind", F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
        star = many.where((F.col("copies") > expand_copies) & (F.col("id") != F.col("rep"))).select("kind", F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
        ends = m.where((F.col("copies") <= expand_copies) | (F.col("id") == F.col("rep"))).select("kind", "id", "rep")
        across = self.links().join(ends.select("kind", F.col("rep").alias("a"), F.col("id").alias("x")), ["kind", "a"]).join(ends.select("kind", F.col("rep").alias("b"), F.col("id").alias("y")), ["kind", "b"])
        return inner.unionByName(star).unionByName(across.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))

    def groups(self) -> DataFrame:
        """``(kind, id, class_id, copies, group_id, links)``, one row per id that took part: its class of equal shingle sets
        and the class's size, its group of linked classes (the smallest id in it) and the number of links of its class."""
        links = self.links()
        key = lambda c: F.concat_ws("\x00", "kind", c)
        cc = connected_components(links.select(key("a").alias("a"), key("b").alias("b")), "a", "b")
        n = links.select(F.col("kind"), F.explode(F.array("a", "b")).alias("rep")).groupBy("kind", "rep").agg(F.count("*").alias("links"))
        m = self.members.select("kind", "id", F.col("rep").alias("class_id"), "copies", key("rep").alias("node"))
        out = m.join(cc, "node", "left").join(n.withColumnRenamed("rep", "class_id"), ["kind", "class_id"], "left")
        return out.select("kind", "id", "class_id", "copies", F.coalesce(F.substring_index("component", "\x00", -1), "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
