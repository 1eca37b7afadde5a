"""Language-model scoring with an Elias-Fano n-gram trie.

The model interpolates absolutely discounted n-grams, order by order down to add-0.1 unigrams:
``p(w|u v) = max(c(u v,w) - d, 0) / c(u v) + d * n(u v) / c(u v) * p(w|v)``, n being the distinct words seen after a context.

It grows with the corpus, so it is never in one place. Contexts are dealt to buckets; each bucket sums its counts,
builds its part of the trie, and answers for exactly the n-grams that each slice of documents has asked for:

* a slice of documents (some megabytes of whole texts) sends every bucket that has any its distinct n-grams with their
  training counts, packed, so a frequent context costs a bucket one entry a slice and distinct follower;
* a bucket replies with exact word counts, and with quantised probabilities looked up in its trie;
* replies and texts of a slice meet, and every document is scored. The texts travel along, compressed.

Two shuffles, after a pass that counts tokens and distinct words; only these two numbers reach the driver. A level's file is a temporary one of the task that made it, made anew
if the task is.

Words are told by 64 bits. A context is told by 32 bits besides those that chose its bucket, so by more the more buckets
the corpus needs; its followers by 32 bits.
"""

from __future__ import annotations

import itertools
import math
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import lowered, mix, slices, word_hashes, words
from .language_id import remainder
from .packed import batches, bucket_edges, pack, unpack
from .shared import buckets_for, release_shuffles, small_batches

DISCOUNT = 0.75
ORDER = 3
SLICE = 14 << 20
END = mix(np.array([0xE0D], np.uint64))[0]
START = mix(np.array([0x57A47], np.uint64))[0]

#: Quantised log10 probabilities: code 0 is "none", code c stands for -(255 - c) * step. Steps span these decades at least.
DECADES = 12


def step_for(tokens: int) -> float:
    """The step whose smallest code is below all numbers of a model of so many training tokens."""
    return max(DECADES, math.log10(4 * max(tokens, 1)) + 0.1) / 254


def quantise(p: np.ndarray, step: float) -> np.ndarray:
    code = 255 + np.round(np.log10(np.maximum(p, 1e-300)) / step)
    return np.where(p > 0, np.clip(code, 1, 255), 0).astype(np.uint8)


def decoded(step: float) -> np.ndarray:
    """What each code stands for."""
    return np.concatenate([[0.0], 10 ** (-(255 - np.arange(1, 256)) * step)])


@dataclass
class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits an entry."""

    n: int
    width: int  # bits of the low part
    low: np.ndarray  # packed low parts
    high: np.ndarray  # bit (value >> width) + index is set for every entry
    ones: np.ndarray  # set bits before each word of high

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            bit = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            part = values & np.uint64((1 << width) - 1)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(width) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        top = values >> np.uint64(width)
        at = top.astype(np.int64) + np.arange(n)
        high = np.zeros((n + (universe >> width) + 2) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1]
        return cls(n, width, low, high, ones)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th (from 0) set or clear bit of ``high``."""
        before = 64 * np.arange(len(self.ones)) - self.ones if zeros else self.ones
        word = np.searchsorted(before, k, "right") - 1
        bits = ~self.high[word] if zeros else self.high[word]
        left = (k - before[word]).astype(np.int64)
        at = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            skip = left >= count
            left -= np.where(skip, count, 0)
            bits = np.where(skip, bits >> np.uint64(half), bits)
            at += np.where(skip, half, 0)
        return word * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        top = (self._select(i, False) - i).astype(np.uint64)
        return (top << np.uint64(self.width)) | self.lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first entry that is at least x, n if there is none."""
        top = (x >> np.uint64(self.width)).astype(np.int64)
        rest = x & np.uint64((1 << self.width) - 1)
        lo = np.where(top > 0, self._select(np.maximum(top - 1, 0), True) - (top - 1), 0)
        hi = self._select(top, True) - top
        while True:  # entries between lo and hi share their high part and rise in their low part
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) >> 1
            less = self.lows(mid) < rest[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]


def _mapped(parts: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in an unnamed file that is mapped, so that memory holds only what is looked at."""
    with tempfile.TemporaryFile() as file:
        for a in parts:
            file.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
        file.flush()
        mapped = np.memmap(file, np.uint8, "r") if file.tell() else np.zeros(0, np.uint8)
    at, views = 0, []
    for a in parts:
        views.append(mapped[at : at + a.nbytes].view(a.dtype))
        at += a.nbytes + (-a.nbytes % 8)
    return views


class Unigrams:
    """The trie's first level: the words of a bucket, and how often each was seen."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        """words: rising 64-bit hashes."""
        self.words = EliasFano.build(words, 1 << 64)
        self.words.low, self.words.high, self.words.ones, self.counts = _mapped([*self.words.arrays(), counts.astype(np.int64)])

    def look_up(self, words: np.ndarray) -> np.ndarray:
        if not self.words.n:
            return np.zeros(len(words), np.int64)
        at = self.words.successor(words)
        safe = np.minimum(at, self.words.n - 1)
        return np.where((at < self.words.n) & (self.words.get(safe) == words), self.counts[safe], 0)


class Level:
    """A further level: contexts, pointers to their followers, and followers, with a quantised number at each node.

    Followers are numbered context by context: entry ``rank(context) * 2**32 + follower`` of one Elias-Fano sequence,
    searched for within its context's range. Everything lives in a memory-mapped file.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discount: float, step: float):
        """keys: context << 32 | follower, rising; counts: positive."""
        context = keys >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([first, [len(keys)]]))
        total = np.add.reduceat(counts, first) if len(keys) else np.zeros(0)
        rank = np.repeat(np.arange(len(first), dtype=np.uint64), sizes)
        self.contexts = EliasFano.build(context[first], 1 << 32)
        self.pointers = EliasFano.build(np.concatenate([first, [len(keys)]]), len(keys) + 1)
        self.followers = EliasFano.build(rank << np.uint64(32) | keys & np.uint64(0xFFFFFFFF), max(1, len(first)) << 32)
        seen = quantise(np.maximum(counts - discount, 0) / np.repeat(total, sizes), step)
        back_off = quantise(np.minimum(discount * sizes / np.maximum(total, 1), 1.0), step)
        levels = (self.contexts, self.pointers, self.followers)
        views = _mapped([a for x in levels for a in x.arrays()] + [seen, back_off])
        for k, x in enumerate(levels):
            x.low, x.high, x.ones = views[3 * k : 3 * k + 3]
        self.seen, self.back_off = views[9:]

    def rank(self, contexts: np.ndarray) -> np.ndarray:
        """Place of each context, -1 if it has none."""
        if not self.contexts.n:
            return np.full(len(contexts), -1)
        at = self.contexts.successor(contexts.astype(np.uint64))
        safe = np.minimum(at, self.contexts.n - 1)
        return np.where((at < self.contexts.n) & (self.contexts.get(safe) == contexts), safe, -1)

    def look_up(self, contexts: np.ndarray, sizes: np.ndarray, followers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each (context, follower), 0 if unseen, and of each context's back-off weight, 0 if unseen."""
        rank = self.rank(contexts)
        back = np.where(rank >= 0, self.back_off[np.maximum(rank, 0)] if len(self.back_off) else 0, 0).astype(np.uint8)
        wide = np.repeat(rank, sizes)
        out = np.zeros(len(followers), np.uint8)
        live = np.flatnonzero(wide >= 0)
        if len(live):
            r = wide[live]
            # the range comes once a context
            known = np.maximum(rank, 0)
            end = np.repeat(self.pointers.get(known + 1).astype(np.int64), sizes)[live]
            target = r.astype(np.uint64) << np.uint64(32) | followers[live].astype(np.uint64)
            at = self.followers.successor(target)
            inside = at < end
            at = np.minimum(at, self.followers.n - 1)
            hit = inside & (self.followers.lows(at) == target & np.uint64((1 << self.followers.width) - 1)) & (self.followers.get(at) == target)
            out[live] = np.where(hit, self.seen[at], 0)
        return out, back


@dataclass
class Tokens:
    """Tokens of some documents in order, an END after each: hashes, document numbers, and places in the document."""

    word: np.ndarray
    doc: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Tokens:
        parts, docs = [], []
        for s in slices(column):
            w = words(s)
            places = w.first[1:]
            parts.append(np.insert(word_hashes(lowered(s.data), w), places, END))
            docs.append(np.insert(w.doc, places, np.arange(len(s))) + s.first)
        word = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        first = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
        at = np.arange(len(doc))
        return cls(word, doc, at - np.maximum.accumulate(np.where(first, at, 0)))

    def contexts(self, n: int) -> np.ndarray:
        """A hash of the n tokens before each; STARTs stand before a document."""
        out = np.zeros(len(self.word), np.uint64)
        for k in range(1, n + 1):
            before = np.full(len(self.word), START, np.uint64)
            before[k:] = np.where(self.place[k:] >= k, self.word[:-k], START)
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + before)
        return out


@dataclass
class Grams:
    """Distinct n-grams of some tokens by bucket: keys that rise within each, bucket edges, and each token's n-gram."""

    keys: np.ndarray
    edges: np.ndarray
    back: np.ndarray

    @classmethod
    def of(cls, t: Tokens, n: int, buckets: int) -> Grams:
        """Unigrams have the words' hashes for keys, others context << 32 | follower; low bits choose the bucket."""
        chooser = t.word if n == 1 else t.contexts(n - 1)
        keys = t.word if n == 1 else (chooser & np.uint64(0xFFFFFFFF00000000)) | t.word >> np.uint64(32)
        bucket = ((chooser & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
        order = np.lexsort((keys, bucket))
        keys, bucket = keys[order], bucket[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])
        back = np.empty(len(keys), np.int64)
        back[order] = np.cumsum(new) - 1
        return cls(keys[new], np.searchsorted(bucket[new], np.arange(buckets + 1)), back)

    def runs(self) -> np.ndarray:
        """Where each context's followers begin, all buckets in one; and the end."""
        context = self.keys >> np.uint64(32)
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        new[self.edges[self.edges < len(context)]] = True
        return np.append(np.flatnonzero(new), len(context))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising keys as contexts, followers a context, followers."""
    context = (keys >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return context[first], np.diff(np.concatenate([first, [len(keys)]])).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def squeezed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers byte plane by byte plane, compressed; small numbers take little room."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return np.frombuffer(zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes()), np.uint8)


def unsqueezed(x: np.ndarray, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x.tobytes()), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(kind).reshape(-1)


def _packed_grams(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """N-grams of a message: contexts by their distances, followers by their numbers among the message's distinct ones."""
    context, n, follower = _runs(keys)
    known, number = np.unique(follower, return_inverse=True)
    number = number.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
    return pack(squeezed(np.diff(context, prepend=np.uint32(0))), squeezed(n), squeezed(np.diff(known, prepend=np.uint32(0))), squeezed(number), squeezed(counts))


def _unpacked_grams(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    context, n, known, number, counts = unpack(blob, *[np.uint8] * 5)
    context = np.cumsum(unsqueezed(context, np.uint32), dtype=np.uint32)
    known = np.cumsum(unsqueezed(known, np.uint32), dtype=np.uint32)
    follower = known[unsqueezed(number, np.uint16 if len(known) <= 1 << 16 else np.uint32)]
    return np.repeat(context, unsqueezed(n, np.uint32)).astype(np.uint64) << np.uint64(32) | follower, unsqueezed(counts, np.uint32)


def vocabulary(texts: DataFrame, buckets: int) -> tuple[int, int]:
    """Tokens of all texts, and how many distinct ones there are."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])

    def emit(held: list[np.ndarray], n: int):
        words = np.unique(np.concatenate(held))
        edges = bucket_edges(words, buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            yield {"bucket": b, "n": n, "blob": pack(squeezed(np.diff(words[edges[b] : edges[b + 1]], prepend=np.uint64(0))))}
            n = 0  # told once

    def post(frames):
        def out():
            held, size, n = [], 0, 0
            for batch in frames:
                for s in slices(batch.column(0)):
                    w = words(s)
                    n += len(w) + len(s)
                    held.append(np.unique(np.append(word_hashes(lowered(s.data), w), END)))
                    size += len(held[-1])
                    if size > 2_000_000:
                        yield from emit(held, n)
                        held, size, n = [], 0, 0
            if held:
                yield from emit(held, n)

        yield from batches(out(), schema)

    def count(frames):
        parts, n = [], 0
        for batch in frames:
            n += sum(batch.column(1).to_pylist())
            parts += [np.cumsum(unsqueezed(unpack(x, np.uint8)[0], np.uint64)) for x in batch.column(2).to_pylist()]
        known = len(np.unique(np.concatenate(parts))) if parts else 0
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "distinct": pa.array([known], pa.int64())})

    counted = texts.mapInArrow(post, "bucket int, n long, blob binary").repartition(buckets, "bucket").mapInArrow(count, "n long, distinct long")
    total = counted.agg(F.sum("n"), F.sum("distinct")).first()
    return total[0] or 0, total[1] or 0


DOCS = 0  # n-grams of order n have kind n
_SCHEMA = "dest int, slice long, kind int, bucket int, blob binary"
_ARROW = pa.schema([("dest", pa.int32()), ("slice", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, discount: float = DISCOUNT, slice_bytes: int = SLICE, order: int = ORDER
) -> DataFrame:
    """Scores every text with a model of all texts outside fold 0 (crc32 of the id as text, modulo ``folds``).

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (unigrams) and
    ``score`` (the trie of n-grams up to ``order``), one row a row. Tokens are lower-cased words and an end. Counts of
    words are exact; the model's numbers above are quantised to 8 bits.

    A null text counts as empty and has its end token only; a null id is held out; repeated rows each count and each
    get a row; without training rows, c = N = V = 0 and every token has probability 1; an empty table gives no rows;
    other columns are not read.
    """
    small_batches(docs.sparkSession)
    buckets = buckets_for(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (remainder(id_col, folds) == 0).alias("held"), F.col(text_col).alias("text"))
    total, distinct = vocabulary(rows.where("not held").select("text"), buckets)
    release_shuffles(docs.sparkSession)
    step = step_for(total)  # the least number is (1 - discount) / total, or discount / total
    codes = decoded(step)

    def post(frames):
        part, slices_done = TaskContext.get().partitionId(), itertools.count()

        def one(ids, held, texts):
            t = Tokens.of(texts)
            train = ~held[t.doc]
            plain = texts.cast(pa.large_binary())
            data = zstandard.ZstdCompressor(level=9).compress(b"".join(x or b"" for x in plain.to_pylist()))
            sizes = pa.compute.fill_null(pa.compute.binary_length(plain), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            blob = pack(ids.fill_null(0).to_numpy(), null, held, sizes, np.frombuffer(data, np.uint8))
            number = next(slices_done)
            name = part << 32 | number  # of this slice alone, also where another has equal rows
            yield {"dest": (part + number) % buckets, "slice": name, "kind": DOCS, "bucket": 0, "blob": blob}
            for n in range(1, order + 1):
                g = Grams.of(t, n, buckets)
                counts = np.bincount(g.back, train, len(g.keys)).astype(np.uint32)
                for b in np.flatnonzero(np.diff(g.edges)).tolist():
                    own = slice(g.edges[b], g.edges[b + 1])
                    if n == 1:
                        blob = pack(squeezed(np.diff(g.keys[own], prepend=np.uint64(0))), squeezed(counts[own]))
                    else:
                        blob = _packed_grams(g.keys[own], counts[own])
                    yield {"dest": b, "slice": name, "kind": n, "bucket": b, "blob": blob}

        def out():
            held, size = [], 0
            for batch in frames:
                lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
                at = 0
                while at < len(batch):
                    to = at
                    while to < len(batch) and (size < slice_bytes or not held and to == at):
                        size += int(lengths[to])
                        to += 1
                    held.append(batch.slice(at, to - at))
                    at = to
                    if size >= slice_bytes:
                        yield from joined(held)
                        held, size = [], 0
            if held:
                yield from joined(held)

        def joined(held):
            table = pa.Table.from_batches(held).combine_chunks()
            ids, flags, texts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
            yield from one(ids, flags.to_numpy(zero_copy_only=False), texts)

        yield from batches(out(), _ARROW)

    def answer(frames):
        asked: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        for batch in frames:
            kinds, names, dests = (batch.column(i).to_pylist() for i in (2, 1, 3))
            mine = np.array(kinds) == DOCS
            if mine.any():
                yield batch.filter(pa.array(mine))
            for i in np.flatnonzero(~mine).tolist():
                asked.setdefault((kinds[i], dests[i]), []).append((names[i], batch.column(4)[i].as_py()))

        def replies():
            for kind, bucket in sorted(asked):
                messages = asked.pop((kind, bucket))
                yield from (words_of if kind == 1 else grams_of)(kind, bucket, messages)

        def summed(parts):
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        def words_of(kind, bucket, messages):
            parts = []
            for _, blob in messages:
                keys, counts = unpack(blob, np.uint8, np.uint8)
                parts.append((np.cumsum(unsqueezed(keys, np.uint64)), unsqueezed(counts, np.uint32)))
            keys, counts = summed(parts)
            level = Unigrams(keys[counts > 0], counts[counts > 0])
            for (name, _), (words, _) in zip(messages, parts, strict=True):
                yield {"dest": 0, "slice": name, "kind": kind, "bucket": bucket, "blob": pack(squeezed(level.look_up(words).astype(np.uint64)))}

        def grams_of(kind, bucket, messages):
            parts = [_unpacked_grams(blob) for _, blob in messages]
            keys, counts = summed(parts)
            level = Level(keys[counts > 0], counts[counts > 0], discount, step)
            for (name, _), (own, _) in zip(messages, parts, strict=True):
                seen, back_off = level.look_up(*_runs(own))
                yield {"dest": 0, "slice": name, "kind": kind, "bucket": bucket, "blob": pack(squeezed(seen), squeezed(back_off))}

        yield from batches(replies(), _ARROW)

    def score(frames):
        name, held = None, []
        for batch in frames:
            for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), range(len(batch)), strict=True):
                if row[0] != name:
                    if held:
                        yield scored(held)
                    name, held = row[0], []
                held.append((row[1], row[2], batch.column(4)[row[3]].as_py()))
        if held:
            yield scored(held)

    def scored(held):
        held.sort(key=lambda x: x[:2])
        ids, null, flags, sizes, data = unpack(held[0][2], np.int64, np.bool_, np.bool_, np.int64, np.uint8)
        text = zstandard.ZstdDecompressor().decompress(data.tobytes())
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        column = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text))
        t = Tokens.of(column)
        answers = lambda n, *kinds: [unpack(blob, *kinds) for kind, _, blob in held if kind == n]
        g = Grams.of(t, 1, buckets)
        count = np.concatenate([unsqueezed(x[0], np.uint64) for x in answers(1, np.uint8)])[g.back]
        p1 = p = (count + 0.1) / (total + 0.1 * (distinct + 1))
        for k in range(2, order + 1):
            g = Grams.of(t, k, buckets)
            both = answers(k, np.uint8, np.uint8)
            seen = codes[np.concatenate([unsqueezed(x[0], np.uint8) for x in both])[g.back]]
            rest = np.repeat(np.concatenate([unsqueezed(x[1], np.uint8) for x in both]), np.diff(g.runs()))[g.back]
            p = seen + np.where(rest == 0, 1.0, codes[rest]) * p  # a context never seen leaves all to the order below
        n = len(ids)
        sums = [np.bincount(t.doc, np.log10(x), n) for x in (p1, p)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=null), pa.array(flags), pa.array(np.bincount(t.doc, minlength=n).astype(np.int64)),
                pa.array(np.bincount(t.doc, count > 0, n).astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(sums[0]), pa.array(sums[1]),
            ],
            [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    asked = rows.mapInArrow(post, _SCHEMA).repartition(buckets, "dest")
    answered = asked.mapInArrow(answer, _SCHEMA).repartition(buckets, "slice").sortWithinPartitions("slice")
    return answered.mapInArrow(
        score, f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
