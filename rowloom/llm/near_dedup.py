"""MinHash near-duplicate detection by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every text becomes its set of hashed shingles, and that a signature of K minima. Texts with equal sets form one
   class, which only its smallest id represents from then on; so exact copies cost one row each and no pair.
2. Representatives are posted under each (coordinate, value). Two sets of similarity s agree in K*s coordinates on
   average, and a pair needs at least M agreements. Coordinates nobody shares can't agree, so a document with fewer
   than M shared ones drops out; of the others each document is posted under its rarest only, as many as two documents
   with M agreements can't both avoid (prefix filter), and common values are skipped.
3. Documents that meet in a posting list are grouped by connected components of the lists. Inside a group, cut into
   blocks that meet pairwise, posting lists of coordinate values are merged: a document's shorter lists name the
   documents that may agree with it often enough, its longest M - 1 lists are skipped, collisions are counted, and pairs
   of M or more are confirmed on full sets. A block pair emits a spanning forest of its links, never all pairs.
4. Connected components of the links give every document its group.

Minima have 64 bits, so that unrelated documents don't share values by chance, however many there are.

K is 32, and M is the largest that misses a pair at the threshold with probability MISS at most: 17 at 0.85 (3.5e-6), 14
at 0.8 (1.2e-6). Every other step is exact, up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Slice, grams, inside, lowered, mix, ragged, slices, word_hashes, words
from .shared import connected_components, discard, fresh, small_batches, stored

SHINGLE = 5
COORDINATES = 32
MISS = 4e-6
BLOCK = 2048
PIECE = 256

_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def matches(percent: int) -> int:
    """Agreements M that a pair at the threshold falls short of with probability MISS at most."""
    p, missed, m = percent / 100, 0.0, 0
    while m < COORDINATES:
        missed += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if missed > MISS:
            break
        m += 1
    if not 0 < percent <= 100 or not m:
        raise ValueError(f"percent is {percent}; {COORDINATES} coordinates find pairs from 33 to 100")
    return m


def shingle_sets(s: Slice, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a slice, sorted, and where each text's begin."""
    data = lowered(s.data)
    w = words(s)
    hashes = word_hashes(data, w)
    at = inside(w, n)
    keys, doc = grams(hashes, n)[at], w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    whole = [mix(np.array([len(h)], np.uint64) + grams(h, len(h)))[0] for h in (hashes[w.first[i] : w.first[i + 1]] for i in short.tolist())]
    keys, doc = np.concatenate([keys, np.array(whole, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(len(s) + 1))


def signatures(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """texts x COORDINATES minima, as 64-bit numbers; all ones for an empty set."""
    out = np.full((len(cuts) - 1, COORDINATES), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        for k, seed in enumerate(_SEEDS):
            out[full, k] = np.minimum.reduceat(keys * seed, cuts[full])
    return out


def digests(keys: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell a set from others, for every set between neighbouring cuts."""
    total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])[cuts])
    return mix(total(keys)).view(np.int64), mix(total(keys ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, t (of the text), n_shingles, d1, d2 (a digest of the set; null for an empty one) and signature, a row a row."""
    schema = "doc_id long, t long, n_shingles long, d1 long, d2 long, signature array<long>"

    def run(batches):
        for batch in batches:
            for s in slices(batch.column(2)):
                keys, cuts = shingle_sets(s, shingle)
                sizes = np.diff(cuts)
                empty = sizes == 0
                d1, d2 = digests(keys, cuts)
                sig = signatures(keys, cuts).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * COORDINATES, pa.int32()), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(s.first, len(s)) for i in range(2)),
                        pa.array(sizes.astype(np.int64)), pa.array(d1, mask=empty), pa.array(d2, mask=empty), lists,
                    ],
                    ["doc_id", "t", "n_shingles", "d1", "d2", "signature"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(text_col).alias("t"), text_col).mapInArrow(run, schema)


def candidate_groups(classes: DataFrame, least: int) -> DataFrame:
    """(node, grp): classes that may have a near copy, and the group within which it must be.

    ``classes``: node, signature; one row a distinct set. ``least``: agreements that a pair needs.
    """
    postings = classes.select("node", F.posexplode("signature").alias("k", "v")).select("node", F.xxhash64("k", "v").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    of_doc = postings.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    prefix = of_doc.where(F.size("keys") >= least).select("node", F.explode(F.slice("keys", 1, F.size("keys") - least + 1)).alias("p"))
    prefix = stored(prefix.select("node", F.col("p.key").alias("key")), "prefix")
    heads = prefix.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    # a node goes with the least head of its lists, so that only heads need edges, and equal ones only once
    own = prefix.join(heads, "key").select("node", "head").withColumn("root", F.min("head").over(Window.partitionBy("node")))
    own = stored(own, "roots")
    joined = connected_components(own.where("head <> root").select(F.col("head").alias("a"), F.col("root").alias("b")).distinct())
    roots = own.groupBy("node").agg(F.min("root").alias("root"))
    groups = roots.join(joined.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("component", "root").alias("grp"))
    discard(prefix)
    return groups


class Merger:
    """Posting lists of coordinate values over some signatures; tells which of them agree with one in M places or more."""

    def __init__(self, sig: np.ndarray, least: int):
        n, k = sig.shape
        self.sig, self.least = sig, least
        order = np.argsort(sig, axis=0, kind="stable")  # members of a list keep their order
        rank = np.empty((n, k), np.int64)
        np.put_along_axis(rank, order, np.arange(n)[:, None], 0)
        ordered = np.take_along_axis(sig, order, 0)
        new = np.concatenate([np.ones((1, k), bool), ordered[1:] != ordered[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(n)[:, None], 0), 0)
        end = np.minimum.accumulate(np.where(np.concatenate([new[1:], np.ones((1, k), bool)]), np.arange(1, n + 1)[:, None], n)[::-1], 0)[::-1]
        own = np.arange(k)[None, :] * n
        self.members = order.T.reshape(-1)
        self.start, self.size = np.take_along_axis(begin, rank, 0) + own, np.take_along_axis(end - begin, rank, 0)

    def agreeing(self, i: int) -> np.ndarray:
        """All j <> i with M agreements or more, rising."""
        size = self.size[i]
        prefix = np.argsort(size, kind="stable")[: len(size) - self.least + 1]  # two such documents share one of these
        prefix = prefix[size[prefix] > 1]
        found = np.zeros(len(self.sig), bool)
        found[self.members[ragged(self.start[i, prefix], size[prefix])]] = True
        found[i] = False
        met = np.flatnonzero(found)
        return met[(self.sig[met] == self.sig[i]).sum(1) >= self.least]


def links_between(sets: list[np.ndarray], sig: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among sets; if ``side`` has two values, of those across them."""
    n = len(sets)
    tree = np.arange(n)  # of the forest, that each set is in
    across = len(np.unique(side)) > 1
    sizes = np.array([len(x) for x in sets])
    merger = Merger(sig, matches(percent))
    index = None
    if n > 48:
        # an inverted index of shingles, which counts a set's overlaps with all others at once
        owner = np.repeat(np.arange(n), sizes)
        keys = np.concatenate(sets)
        by = np.argsort(keys, kind="stable")
        index = (keys[by], owner[by])
    for i in range(n):
        others = merger.agreeing(i)
        others = others[(others < i) & (tree[others] != tree[i])]
        if across:
            others = others[side[others] != side[i]]
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * small >= percent * large]
        if not len(others):
            continue
        if index is not None and len(others) > 8:
            left, right = np.searchsorted(index[0], sets[i], "left"), np.searchsorted(index[0], sets[i], "right")
            common = np.bincount(index[1][ragged(left, right - left)], minlength=n)[others]
        else:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others.tolist()])
        union = sizes[others] + sizes[i] - common
        for j in others[100 * common >= percent * union].tolist():
            if tree[j] != tree[i]:
                tree[tree == tree[j]] = tree[i]
                yield i, j


def links(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, percent: int, block: int = BLOCK, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between nodes that connect what links within each group connect.

    ``groups``: node, grp, and rep, d1, d2 of the node's class. A group of more than ``block`` nodes is dealt into blocks;
    every two blocks meet in a task of their own, so a node of a group of n travels n / block times and no task holds
    more than two blocks.
    """
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    # groups of some hundreds are cut too, into 8 blocks at most, so that one of them does not hold up its task
    nb = F.greatest(F.ceil(F.col("n") / block), F.least(F.ceil(F.col("n") / PIECE), F.lit(8)))
    dealt = groups.join(sizes, "grp").withColumn("nb", nb.cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("node", "rep", "d1", "d2", "grp", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    # merged at every size: groups are a share of the corpus, so they'd soon be too many to broadcast
    texts = dealt.join(texts.hint("merge"), "rep")
    texts = texts.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "node")

    def run(batches):
        key, ids, sides, sets = None, [], [], []

        def flush():
            pairs = []
            if len(ids) > 1:
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                sig = signatures(np.concatenate(sets), cuts)
                pairs = [(ids[i], ids[j]) for i, j in links_between(sets, sig, np.array(sides), percent)]
            ids.clear(), sides.clear(), sets.clear()
            return pairs

        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for s in slices(batch.column(7)):
                keys, cuts = shingle_sets(s, shingle)
                digest = [d.tolist() for d in digests(keys, cuts)]
                for i in range(len(s)):
                    node, d1, d2, grp, mine, x, y = (c[s.first + i] for c in columns)
                    if (grp, x, y) != key:
                        out += flush()
                        key = (grp, x, y)
                    # of rows that share an id only those with the class's set speak for it, and one is enough
                    if (digest[0][i], digest[1][i]) == (d1, d2) and (not ids or ids[-1] != node):
                        ids.append(node)
                        sides.append(mine)
                        sets.append(keys[cuts[i] : cuts[i + 1]].copy())
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})
        out = flush()
        yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return texts.select("node", "d1", "d2", "grp", "mine", "x", "y", "text").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, block: int = BLOCK, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, t, n_shingles, node (of the class that stands for the group) and component (its smallest id), a row a row."""
    small_batches(docs.sparkSession)
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = prints.where("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered once, when written
    reps = prints.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2", "node"), ["doc_id", "d1", "d2"])
    groups = candidate_groups(reps.select("node", "signature").dropDuplicates(["node"]), matches(percent))
    found = stored(links(docs, groups.join(classes, "node"), id_col, text_col, percent, block, shingle), "links")
    joined = connected_components(found)
    discard(found)
    parts = classes.join(joined, "node", "left").withColumn("node", F.coalesce("component", "node")).drop("component")
    least = parts.groupBy("node").agg(F.min("rep").alias("component"))
    named = parts.join(least, "node").select("d1", "d2", "node", "component")
    out = prints.drop("signature").join(named, ["d1", "d2"], "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "t", "n_shingles", F.when(known, F.col("node")).alias("node"), F.when(known, F.coalesce("component", "doc_id")).alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, block: int = BLOCK, shingle: int = SHINGLE) -> DataFrame:
    """Group of every document: ``id_col``, ``n_shingles``, ``component_id`` (smallest id in the group) and ``kept``.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct shingles; groups are the
    connected components of the links, and ``kept`` holds for the document that names its group. ``percent`` is 33 to 100;
    below, too many links would be missed.

    A null, empty or blank text has no shingle and is linked with nothing; fewer words than a shingle's form one shingle
    together; rows that repeat an id each get a row, by their own text; a null id is linked with nothing, has a null
    group and is kept; an empty table gives no rows; other columns are not read.
    """
    out = _grouped(docs, id_col, text_col, percent, block, shingle)
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), kept)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group: of the smallest id, and of rows that share it the one whose text's hash is least.

    Rows that repeat an id and a text count once; rows that share an id and differ are documents of their own. A null or
    blank text and a row with a null id always stay; an empty table gives no rows; all columns pass through.
    """
    t, own_id, own_t = fresh(docs.columns, "_t", "_id", "_own_t")
    groups = _grouped(docs, id_col, text_col, percent).where("node is not null")
    chosen = groups.groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("k")).select(F.col("k.doc_id").alias(own_id), F.col("k.t").alias(own_t))
    apart = F.col(id_col).cast("long").isNull() | ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = docs.where(~apart).withColumn(t, _text_key(text_col))
    rest = rest.join(chosen, (F.col(id_col).cast("long") == F.col(own_id)) & (F.col(t) == F.col(own_t)))
    return rest.dropDuplicates([own_id, own_t]).select(*docs.columns).unionByName(docs.where(apart))
