"""Exact substring dedup: suffix automata of reference shards, against which repeated passages are streamed.

A *window* is ``length`` consecutive words of one document; a word goes if some window that covers it also starts
earlier in the corpus. An automaton of the whole corpus would not fit anywhere and every document would have to visit
every shard of it, so passages are first brought to the one shard that can hold their match:

1. Every window has an anchor, the least hash among its inner word grams; equal windows have equal anchors. Anchor
   hashes travel in packed arrays, once a slice; those that occur once in the corpus end here, with their windows.
2. Maximal runs of the other windows are segments. Equal segments are a class, for which the earliest one speaks.
3. These are cut into the stretches that one anchor governs, and go to the bucket of the anchor. A bucket cuts the
   different contents of its stretches into reference shards of bounded size, builds the suffix automaton of each, and
   streams the contents through it for matching statistics: where the match is at least ``length`` long, the first end
   position of the state tells whether the window starts earlier elsewhere. A content whose anchor's contents fill more
   than one shard is streamed through all of them.
4. What the automata found of a content goes from all but its first occurrence, and from its first what starts earlier:
   equal stretches and equal segments take the verdict of the one that was streamed. Without it nothing is removed.

Documents are told by their id and a hash of id and text, so null and shared ids keep their texts apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Slice, Words, grams, inside, mix, ragged, slices, word_hashes, words
from .packed import batches, bucket_edges, pack, unpack
from .shared import buckets_for, fresh, release_shuffles, small_batches, stored

LENGTH = 20
GRAM = 6
SHARD_WORDS = 30_000
PASS_WORDS = 400_000  # of a bucket that are matched at a time, unless one anchor has more
POST_BYTES = 4 << 20  # of text whose anchors travel together
LAST_ID = (1 << 63) - 1
HOT = 200_000  # rows of one key that may meet in a task


class SuffixAutomaton:
    """All substrings of a word sequence; each state knows where its strings first end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.first = [-1]
        self.last = 0
        self.size = 0

    def extend(self, word: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        self.first.append(self.size)
        link.append(0)
        p = self.last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                self.first.append(self.first[q])
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        self.size += 1

    def restart(self) -> None:
        """What follows is another text: no substring spans the two."""
        self.last = 0
        self.size += 1

    def first_ends(self, sequence: list[int], length: int) -> list[int]:
        """For every place in a sequence, where its last ``length`` words first end in the texts, or -1."""
        nxt, link, lens, first = self.next, self.link, self.len, self.first
        state = have = 0
        out = []
        for word in sequence:
            while state and word not in nxt[state]:
                state = link[state]
                have = lens[state]
            if word in nxt[state]:
                state = nxt[state][word]
                have += 1
            else:
                have = 0
            if have < length:
                out.append(-1)
                continue
            while lens[link[state]] >= length:  # the state of the match's last ``length`` words
                state = link[state]
            have = min(have, lens[state])
            out.append(first[state])
        return out


def anchors(hashes: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of every window that begins at ``starts``, and the gram hash at every place."""
    g = grams(hashes, gram)
    span = length - gram + 1
    if not len(starts):
        return np.zeros(0, np.int64), g
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    return starts + view[starts].argmin(1), g


def _windows(s: Slice, length: int, gram: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    w = words(s)
    h = word_hashes(s.data, w)
    starts = inside(w, length)
    at, g = anchors(h, starts, length, gram)
    return w, h, starts, at, g


def _flat(doc: np.ndarray, *ints: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), *(pa.array(x.astype(np.int32)) for x in ints)], names)


def repeated_anchors(rows: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """(row, place): the anchors, by the word they begin with, whose gram hash occurs twice or more in the corpus.

    ``rows``: row, text. Rows of equal hashes would only share evidence.
    """
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def post(frames):
        def out():
            for batch in frames:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for s in slices(batch.column(1), POST_BYTES):
                    w, _, _, at, g = _windows(s, length, gram)
                    at = np.unique(at)
                    doc = ids[s.first + w.doc[at]]
                    place = (at - w.first[w.doc[at]]).astype(np.int32)
                    keys, one, back, n = np.unique(g[at], return_index=True, return_inverse=True, return_counts=True)
                    edges = bucket_edges(keys, buckets)
                    here = n[back] > 1  # repeated within the slice: settled, and sent as evidence for other slices
                    yield {"bucket": int(keys[0] % np.uint64(buckets)) if len(keys) else 0, "blob": b"R" + pack(doc[here], place[here])}
                    for b in np.flatnonzero(np.diff(edges)).tolist():
                        own = slice(edges[b], edges[b + 1])
                        yield {"bucket": b, "blob": b"K" + pack(keys[own], doc[one[own]], place[one[own]], n[own] > 1)}

        yield from batches(out(), schema)

    def settle(frames):
        parts = []
        for batch in frames:
            for blob in batch.column(1).to_pylist():
                if blob[:1] == b"R":
                    yield _flat(*unpack(blob[1:], np.int64, np.int32), names=["row", "place"])
                else:
                    parts.append(unpack(blob[1:], np.uint64, np.int64, np.int32, np.bool_))
        if parts:
            keys, doc, place, known = (np.concatenate([p[i] for p in parts]) for i in range(4))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            same = keys[1:] == keys[:-1]
            twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            twice &= ~known[order]
            doc, place = doc[order][twice], place[order][twice]
            for a in range(0, len(doc), 100_000):
                yield _flat(doc[a : a + 100_000], place[a : a + 100_000], names=["row", "place"])

    return rows.select("row", "text").mapInArrow(post, "bucket int, blob binary").repartition(buckets, "bucket").mapInArrow(settle, "row long, place int")


def segments(rows: DataFrame, places: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, row, start, d1, d2, words): maximal runs of windows with repeated anchors, as packed word codes.

    A code is half of the word's hash: for two windows to pass for equal, 19 words must be and the codes of the other
    collide. Copies are told by a 128-bit digest of whole hashes.
    """
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("words", pa.binary())])
    marked = rows.join(places.groupBy("row").agg(F.collect_set("place").alias("places")), "row").select("id", "row", "text", "places")

    def cut(frames):
        def out():
            for batch in frames:
                ids, own_rows, places = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
                flat, ends = places.flatten().to_numpy(zero_copy_only=False), places.offsets.to_numpy()
                for s in slices(batch.column(2)):
                    w, h, starts, at, _ = _windows(s, length, gram)
                    marked = np.zeros(len(w), bool)
                    for i in range(len(s)):
                        own = flat[ends[s.first + i] : ends[s.first + i + 1]]
                        own = own[own < w.first[i + 1] - w.first[i]]
                        marked[w.first[i] + own] = True
                    starts = starts[marked[at]]
                    if not len(starts):
                        continue
                    new = np.ones(len(starts), bool)
                    new[1:] = (np.diff(starts) != 1) | (w.doc[starts[1:]] != w.doc[starts[:-1]])
                    begin = starts[new]
                    end = starts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])] + length
                    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                        digest = np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest(), np.int64)
                        body = (h[a:b] >> np.uint64(32)).astype(np.uint32).tobytes()
                        doc = int(w.doc[a])
                        yield {"id": int(ids[s.first + doc]), "row": int(own_rows[s.first + doc]), "start": int(a - w.first[doc]), "d1": int(digest[0]), "d2": int(digest[1]), "words": body}

        yield from batches(out(), schema)

    return marked.mapInArrow(cut, "id long, row long, start int, d1 long, d2 long, words binary")


def matched_spans(classes: DataFrame, length: int, gram: int, buckets: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, row, start, end, copies): word spans that the automata found in the segments that speak for their classes.

    ``classes``: id, row, start, words, many. Spans with ``copies`` hold for the later segments of the class, given only
    where ``many`` says that there are some; the others hold for the segment itself.
    """
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def post(frames):
        def out():
            held: list[tuple] = []
            size = 0
            for batch in frames:
                for id_, row, start, body, many in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    h = np.frombuffer(body, np.uint32)
                    at, g = anchors(h, np.arange(len(h) - length + 1), length, gram)
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
                    sizes = np.diff(cut) + length - 1
                    full = lambda x, kind: np.full(len(sizes), x, kind)  # noqa: B023, E731
                    held.append((
                        g[at[cut[:-1]]], full(id_, np.int64), full(row, np.int64), (start + cut[:-1]).astype(np.int32), sizes.astype(np.int32), full(many, np.bool_),
                        h[ragged(cut[:-1], sizes)],
                    ))
                    size += int(sizes.sum())
                    if size > 1 << 18:
                        yield from dealt(held)
                        held, size = [], 0
            if held:
                yield from dealt(held)

        yield from batches(out(), schema)

    def dealt(held):
        *columns, body = (np.concatenate([x[i] for x in held]) for i in range(7))
        key, size = columns[0], columns[4]
        order = np.argsort(key, kind="stable")
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        edges = bucket_edges(key[order], buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[b] : edges[b + 1]]
            yield {"bucket": b, "blob": pack(*(c[own] for c in columns), body[ragged(begin[own], size[own])])}

    def match(frames):
        kinds = (np.uint64, np.int64, np.int64, np.int32, np.int32, np.bool_, np.uint32)
        parts = [unpack(blob, *kinds) for batch in frames for blob in batch.column(1).to_pylist()]
        if not parts:
            return
        columns = [np.concatenate([p[i] for p in parts]) for i in range(7)]
        del parts
        for own in _passes(columns[0], columns[4], PASS_WORDS):
            begin = np.cumsum(columns[4], dtype=np.int64) - columns[4]
            body = columns[6][ragged(begin[own], columns[4][own])]
            for id_, row, start, end, copies in matched(*(c[own] for c in columns[:6]), body, length, shard_words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(id_), pa.array(row), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(np.full(len(id_), copies))],
                    ["id", "row", "start", "end", "copies"],
                )

    dealt_out = classes.select("id", "row", "start", "words", "many").mapInArrow(post, "bucket int, blob binary").repartition(buckets, "bucket")
    return dealt_out.mapInArrow(match, "id long, row long, start int, end int, copies boolean")


def _passes(key: np.ndarray, size: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Numbers of stretches with about ``words`` words together, all of a key in one pass."""
    order = np.argsort(key, kind="stable")
    total, ordered = np.cumsum(size[order], dtype=np.int64), key[order]
    a = 0
    while a < len(order):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + words, "right"))
        b = int(np.searchsorted(ordered, ordered[min(max(b, a), len(order) - 1)], "right"))
        yield order[a:b]
        a = b


def _firsts(key: np.ndarray, body: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For every stretch the first one, in the order given, that has its words."""
    longest = int(size.max(initial=0))
    digest = mix(key ^ mix(size.astype(np.uint64)))
    for k in range(longest):
        live = np.flatnonzero(size > k)
        digest[live] = mix(digest[live] ^ body[begin[live] + k])
    _, first, back = np.unique(digest, return_index=True, return_inverse=True)
    return first[back]


def matched(key, id_, row, start, size, many, body, length: int, shard_words: int) -> Iterator[tuple]:
    """Found spans (id, row, start, end, copies) among stretches of words; stretches that share a window share a key."""
    begin = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[:-1]
    order = np.lexsort((start, row, id_, key))
    key, id_, row, start, size, many, begin = (x[order] for x in (key, id_, row, start.astype(np.int64), size.astype(np.int64), many, begin))
    speaker = _firsts(key, body, begin, size)
    speaks = speaker == np.arange(len(key))
    repeated = np.bincount(speaker, minlength=len(key)) > 1
    np.logical_or.at(repeated, speaker, many)
    # windows that no other stretch has and nothing repeats need no automaton
    own = np.flatnonzero(speaks)
    first = ragged(begin[own], size[own] - length + 1)
    owner = np.repeat(own, size[own] - length + 1)
    g = grams(body, length)[first]
    _, back, count = np.unique(g, return_inverse=True, return_counts=True)
    wanted = (count[back] > 1) | repeated[owner]
    first, owner = first[wanted], owner[wanted]
    if not len(first):
        return
    new = np.ones(len(first), bool)
    new[1:] = (np.diff(first) != 1) | (np.diff(owner) != 0)
    where = np.flatnonzero(new)
    piece_size = np.diff(np.concatenate([where, [len(first)]])) + length - 1
    piece_owner, piece_begin = owner[where], first[where]
    piece_key, piece_shift = key[piece_owner], piece_begin - begin[piece_owner]
    content = _firsts(piece_key, body, piece_begin, piece_size)
    distinct = np.flatnonzero(content == np.arange(len(content)))
    earlier, found = shards(piece_key[distinct], piece_begin[distinct], piece_size[distinct], body, length, shard_words)
    number = np.searchsorted(distinct, content)  # of each piece's content
    # spans of every piece: all that was found of its content, and at the content's first place what starts earlier
    all_piece, all_from, all_to = _expanded(np.arange(len(content)), number, found)
    is_first = content == np.arange(len(content))
    own_piece, own_from, own_to = _expanded(np.flatnonzero(is_first), number[is_first], earlier)
    later = ~is_first[all_piece]
    of = np.concatenate([own_piece, all_piece[later]])
    a, b = np.concatenate([own_from, all_from[later]]), np.concatenate([own_to, all_to[later]])
    o = piece_owner[of]
    shift = start[o] + piece_shift[of]
    yield id_[o], row[o], shift + a, shift + b, False
    # by speaker, for the stretches and the segments that repeat it
    by = np.argsort(piece_owner[all_piece], kind="stable")
    spans = np.searchsorted(piece_owner[all_piece][by], np.arange(len(key) + 1))
    for members, copies in ((np.flatnonzero(~speaks), False), (np.flatnonzero(many), True)):
        n = (spans[1:] - spans[:-1])[speaker[members]]
        x, m = by[ragged(spans[:-1][speaker[members]], n)], np.repeat(members, n)
        shift = start[m] + piece_shift[all_piece[x]]
        yield id_[m], row[m], shift + all_from[x], shift + all_to[x], copies


def _expanded(members: np.ndarray, number: np.ndarray, spans: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each member's content, which ``number`` names, one after the other."""
    sizes = np.array([len(x) for x in spans], np.int64)
    flat = np.array([y for x in spans for y in x], np.int64).reshape(-1, 2)
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    x = ragged(at[number], sizes[number])
    return np.repeat(members, sizes[number]), flat[x, 0], flat[x, 1]


def shards(key, begin, size, body, length: int, shard_words: int) -> tuple[list, list]:
    """Of different contents in corpus order by key: the word spans that start earlier elsewhere, and those found at all.

    Automata hold about ``shard_words`` words. Contents that come after a shard and share its last key visit it as well.
    """
    _, code = np.unique(body[ragged(begin, size)], return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    texts = lambda i: code[at[i] : at[i + 1]].tolist()
    n = len(key)
    earlier, found = [np.zeros(s, bool) for s in size.tolist()], [np.zeros(s, bool) for s in size.tolist()]
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + shard_words, "right")) - 1)
        automaton = SuffixAutomaton()
        for i in range(a, b):
            for word in texts(i):
                automaton.extend(word)
            automaton.restart()
        last = int(np.searchsorted(key, key[b - 1], "right"))
        for i in range(a, max(b, last)):
            ends = np.array(automaton.first_ends(texts(i), length))
            own = int(at[i] - at[a]) + i - a if i < b else 1 << 60  # where it begins in the automaton's numbering
            found[i] |= ends >= 0
            earlier[i] |= (ends >= 0) & (ends < own + np.arange(len(ends)))
        a = b
    return [_spans(x, length) for x in earlier], [_spans(x, length) for x in found]


def _spans(ends: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Windows by their last words as spans, joined where they follow one another."""
    x = np.flatnonzero(ends)
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x) != 1)
    return list(zip((x[np.concatenate([[0], cut + 1])] - length + 1).tolist(), (x[np.concatenate([cut, [len(x) - 1]])] + 1).tolist(), strict=True))


def copied_spans(found: DataFrame, classes: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, row, start, end): spans of the later segments of each class, as the automata found them in the first.

    A class of more than HOT segments is salted: such classes are a HOT-th of the segments at most, so they are broadcast.
    """
    known = spans.where("copies").groupBy("id", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    of_class = classes.where("many").select("d1", "d2", "n", "id", "row", "start", F.length("words").alias("bytes")).join(known, ["id", "row"])
    until = F.col("start") + (F.col("bytes") / 4).cast("int")
    inner = F.filter("spans", lambda x: (x["start"] >= F.col("start")) & (x["end"] <= until))
    moved = F.transform(inner, lambda x: F.named_struct(F.lit("start"), x["start"] - F.col("start"), F.lit("end"), x["end"] - F.col("start")))
    salts = F.ceil(F.col("n") / HOT).cast("int")
    cover = of_class.select("d1", "d2", moved.alias("cover"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    hot = classes.where(F.col("n") > HOT).select("d1", "d2", salts.alias("salts"))
    later = found.select("id", "row", "start", "d1", "d2").join(classes.select("id", "row", "start"), ["id", "row", "start"], "left_anti")
    later = later.join(F.broadcast(hot), ["d1", "d2"], "left").withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.coalesce("salts", F.lit(1))).cast("int"))
    one = later.join(cover, ["d1", "d2", "salt"]).select("id", "row", F.col("start").alias("from"), F.explode("cover").alias("x"))
    return one.select("id", "row", (F.col("from") + F.col("x.start")).alias("start"), (F.col("from") + F.col("x.end")).alias("end"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (nulls last), row (a hash of id and text) and text."""
    own, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(F.coalesce(own, F.lit(LAST_ID)).alias("id"), F.xxhash64(own, text).alias("row"), text.alias("text"))


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, row, spans): for every document that loses words, the spans [start, end) of word numbers, perhaps overlapping."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    buckets = buckets_for(docs, text_col)
    rows = _rows(docs, id_col, text_col)
    places = repeated_anchors(rows, length, gram, buckets)
    found = stored(segments(rows, places, length, gram), "segments")
    del places
    release_shuffles(spark)  # the anchors and one shuffle of all texts
    # the earliest of equal segments, with its words: equal ones of a task meet before the shuffle
    whole = F.struct("id", "row", "start", "words")
    classes = found.groupBy("d1", "d2").agg(F.min_by(whole, F.struct("id", "row", "start")).alias("s"), F.count("*").alias("n"))
    classes = stored(classes.select("d1", "d2", "n", (F.col("n") > 1).alias("many"), "s.*"), "classes")
    spans = stored(matched_spans(classes, length, gram, buckets), "spans")
    every = spans.where("not copies").select("id", "row", "start", "end").unionByName(copied_spans(found, classes, spans))
    return every.groupBy("id", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Every document without the words covered by a window that also starts earlier.

    Returns ``id_col``, ``n_words``, ``n_removed`` and ``kept_text`` (the kept words joined by one space), one row a row.
    "Earlier" is a smaller id, or the same document and an earlier start; windows are judged on the input.

    A null or blank text has no words and an empty ``kept_text``; a text of fewer than ``length`` words is left alone; a
    null id counts as the greatest one; rows that share an id (null included) are documents of their own, in the order of
    a hash of their texts; rows that repeat an id and a text are one document, so they do not remove each other; an empty
    table gives no rows; other columns are not read.
    """
    name, at_text = fresh(["id", "row", "start", "end"], id_col, "_text")
    rows = _rows(docs, id_col, text_col).select("id", "row", F.col("text").alias(at_text))
    joined = rows.join(removed_spans(docs, id_col, text_col, length), ["id", "row"], "left")
    null = F.col("row") == F.xxhash64(F.lit(None).cast("long"), F.col(at_text))  # of the two that LAST_ID stands for
    real = F.when(~((F.col("id") == LAST_ID) & null), F.col("id"))
    joined = joined.select(real.alias(name), at_text, "spans.start", "spans.end")

    def rebuild(frames):
        for batch in frames:
            starts, ends = batch.column(2), batch.column(3)
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (starts, ends)]
            cuts, null = starts.offsets.to_numpy() - starts.offsets[0].as_py(), starts.is_null().to_numpy(zero_copy_only=False)
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            total, removed, kept = [], [], []
            for i, text in enumerate(texts):
                own = (text or b"").split()
                total.append(len(own))
                gone = np.zeros(len(own) + 1, np.int32)
                if not null[i] and cuts[i + 1] > cuts[i]:
                    a, b = cuts[i], cuts[i + 1]
                    np.add.at(gone, np.minimum(flat[0][a:b], len(own)), 1)
                    np.add.at(gone, np.minimum(flat[1][a:b], len(own)), -1)
                    keep = np.cumsum(gone)[:-1] <= 0
                    own = [own[k] for k in np.flatnonzero(keep).tolist()]
                removed.append(total[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                [id_col, "n_words", "n_removed", "kept_text"],
            )

    return joined.mapInArrow(rebuild, f"{id_col} long, n_words long, n_removed long, kept_text string")
