"""Language identification with bit-sliced Bloom filters of n-grams.

Every slot of the filter holds a bitmask with one bit a language. An n-gram's masks at its k slots are ANDed: what is
left names all languages whose filter contains it. A text's n-grams are looked up together, the set bits of each
language are counted and corrected for that language's false-positive rate, and the largest count decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import Slice, lowered, mix, slices, space_mask
from .packed import batches, bucket_edges, pack, unpack
from .shared import fresh, shuffle_partitions, small_batches, stored

LENGTH = 4  # bytes in an n-gram, which then is a 32-bit number
UNKNOWN = "und"


@dataclass
class LanguageFilter:
    """``masks``: slots x words of language bits; ``languages[i]`` has bit i % 64 of word i // 64.

    Words are as narrow as the languages allow: up to 8 take a byte a slot.
    """

    languages: list[str]
    masks: np.ndarray
    hashes: int
    false_positive: np.ndarray

    @classmethod
    def build(cls, languages: list[str], keys: np.ndarray, members: np.ndarray, hashes: int = 3, bits_per_key: int = 16) -> LanguageFilter:
        """keys: n-grams; members[i, j]: whether language j contains n-gram i."""
        size = 1 << max(10, int(len(keys) * bits_per_key - 1).bit_length())
        width = max(1, -(-len(languages) // 64))
        kind = next((k for n, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(languages) <= n), np.uint64)
        masks = np.zeros((size, width), kind)
        for word in range(width):
            own = members[:, word * 64 : word * 64 + 64]
            bits = (own.astype(np.uint64) << np.arange(own.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64).astype(kind)
            for slot in _slots(keys, hashes, size):
                np.bitwise_or.at(masks[:, word], slot, bits)
        fill = [((masks[:, j // 64] >> kind(j % 64)) & kind(1)).mean() for j in range(len(languages))]
        return cls(languages, masks, hashes, np.array(fill) ** hashes)

    def votes(self, keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Corrected count of each language's n-grams between neighbouring cuts of ``keys``: texts x languages."""
        found = None
        for slot in _slots(keys, self.hashes, len(self.masks)):
            found = self.masks[slot] if found is None else found & self.masks[slot]
        n = np.diff(cuts)[:, None]
        out = np.zeros((len(cuts) - 1, len(self.languages)))
        for j in range(len(self.languages)):
            kind = found.dtype.type
            ones = (found[:, j // 64] >> kind(j % 64)) & kind(1)
            out[:, j] = np.diff(np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])[cuts])
        return np.clip((out - self.false_positive * n) / (1 - np.minimum(self.false_positive, 0.99)), 0, n)


def _slots(keys: np.ndarray, hashes: int, size: int):
    mixed = mix(keys.astype(np.uint64))
    low, high = mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) | np.uint64(1)
    for i in range(hashes):
        yield ((low + np.uint64(i) * high) & np.uint64(size - 1)).astype(np.int64)


def byte_grams(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a slice's texts in order, and where each text's begin.

    White space counts as one kind of byte, and every text has one such byte before and after it.
    """
    data = np.where(space_mask(s.data), np.uint8(32), lowered(s.data))
    data = np.insert(data, np.sort(np.concatenate([s.offsets[:-1], s.offsets[1:]])), np.uint8(32)).astype(np.uint32)
    offsets = s.offsets + 2 * np.arange(len(s) + 1)
    m = len(data) - LENGTH + 1
    if m <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(s) + 1, np.int64)
    keys = np.zeros(m, np.uint32)
    for k in range(LENGTH):
        keys = (keys << np.uint32(8)) | data[k : k + m]
    inner = np.zeros(m, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        inner[a : max(a, b - LENGTH + 1)] = True
    cuts = np.concatenate([[0], np.cumsum(inner)])[np.minimum(offsets, m)]
    return keys[inner], cuts


def has_letter(s: Slice) -> np.ndarray:
    ascii_letter = ((s.data | 32) >= 97) & ((s.data | 32) <= 122)
    out = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[s.offsets]) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in s.text(i).decode("utf-8", "replace"))
    return out


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", ratio: float = 0.5, least: float = 1e-6, buckets: int | None = None) -> LanguageFilter:
    """Learns the filters from all rows of ``docs`` with a language.

    n-grams are counted over all texts, pre-summed in every task. Language l contains an n-gram if its frequency in l is
    at least ``least``, and at least ``ratio`` times that in any language; so a language contains at most 1/least
    n-grams, however large the corpus is, and that bounds what reaches the driver.
    """
    small_batches(docs.sparkSession)
    buckets = buckets or max(64, shuffle_partitions(docs.sparkSession))
    rows_schema = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("blob", pa.binary())])

    def emit(held: dict[str, list]):
        for lang, parts in held.items():
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)
            spread = mix(keys.astype(np.uint64))
            order = np.argsort(spread, kind="stable")
            edges = bucket_edges(spread[order], buckets)
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                yield {"bucket": b, "lang": lang, "blob": pack(keys[own], counts[own])}

    def count(frames):
        def rows():
            held: dict[str, list] = {}
            for batch in frames:
                langs = batch.column(1)
                for lang in langs.unique().to_pylist():
                    for s in slices(batch.column(0).filter(pa.compute.equal(langs, lang))):
                        keys, n = np.unique(byte_grams(s)[0], return_counts=True)
                        mine = held.setdefault(lang, [])
                        mine.append((keys, n))
                        if len(mine) > 8:
                            keys, back = np.unique(np.concatenate([k for k, _ in mine]), return_inverse=True)
                            mine[:] = [(keys, np.bincount(back, np.concatenate([c for _, c in mine])))]
            yield from emit(held)

        yield from batches(rows(), rows_schema)

    def total(key, frame):
        parts = [unpack(x, np.uint32, np.int64) for x in frame.column("blob").to_pylist()]
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
        return pa.table({"bucket": [key[0].as_py()], "lang": [key[1].as_py()], "n": [int(counts.sum())], "blob": [pack(keys, counts)]}, schema=total_schema)

    total_schema = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("blob", pa.binary())])
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = known.mapInArrow(count, "bucket int, lang string, blob binary").groupBy("bucket", "lang").applyInArrow(total, "bucket int, lang string, n long, blob binary")
    counted = stored(counted, "ngrams")
    sizes = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sizes)
    place = {lang: i for i, lang in enumerate(languages)}

    def choose(key, frame):
        parts = [(place[lang], *unpack(x, np.uint32, np.int64)) for lang, x in zip(frame.column("lang").to_pylist(), frame.column("blob").to_pylist(), strict=True)]
        keys = np.unique(np.concatenate([p[1] for p in parts]))
        share = np.zeros((len(keys), len(languages)))
        for j, k, c in parts:
            share[np.searchsorted(keys, k), j] = c / max(1, sizes[languages[j]])
        member = (share >= least) & (share >= ratio * share.max(1, keepdims=True))
        keep = member.any(1)
        return pa.table({"blob": [pack(keys[keep], member[keep])]}, schema=pa.schema([("blob", pa.binary())]))

    chosen = [unpack(r[0], np.uint32, np.bool_) for r in counted.groupBy("bucket").applyInArrow(choose, "blob binary").collect()]
    keys = np.concatenate([c[0] for c in chosen]) if chosen else np.zeros(0, np.uint32)
    members = np.concatenate([c[1] for c in chosen]).reshape(-1, max(1, len(languages)))[:, : len(languages)] if chosen else np.zeros((0, 0), bool)
    return LanguageFilter.build(languages, keys, members)


def predict(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id_col`` (and the columns in ``keep``), ``lang_pred`` and ``score`` for every row of ``docs``.

    ``score`` is the share of the winner's corrected count in those of all languages, 0 if none of the text's n-grams is
    known. A text that is null, empty or without a letter is ``und`` with score 0, as are all texts if nothing was
    learned; ties go to the language that sorts first; a null id stays null; every repeated row gets its row; columns in
    ``keep`` that are named like a result, in any case, are left out; an empty table gives no rows.

    The filter is broadcast: at most languages / least n-grams (see ``fit``), 16 to 32 slots each, so 128 MB for four
    languages that each fill theirs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep or [] if c.lower() not in (id_col.lower(), "lang_pred", "score")]
    (at_text,) = fresh([id_col, *keep], "_text")
    names = [id_col, *keep, "lang_pred", "score"]
    inputs = docs.select(F.col(id_col).cast("long").alias(id_col), *keep, F.col(text_col).alias(at_text))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields[:-1]), "lang_pred string", "score double"])

    def run(frames):
        model = shared.value
        for batch in frames:
            for s in slices(batch.column(len(keep) + 1)):
                keys, cuts = byte_grams(s)
                if model.languages:
                    votes = model.votes(keys, cuts)
                    best = votes.argmax(1)
                    total = votes.sum(1)
                    score = np.where(total > 0, votes.max(1) / np.maximum(total, 1e-12), 0.0)
                    plain = has_letter(s) & ~s.null
                else:
                    best, score, plain = np.zeros(len(s), int), np.zeros(len(s)), np.zeros(len(s), bool)
                lang = [model.languages[b] if p else UNKNOWN for b, p in zip(best.tolist(), plain.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(s.first, len(s)) for i in range(len(keep) + 1)), pa.array(lang, pa.string()), pa.array(np.where(plain, np.clip(score, 0, 1), 0.0))], names
                )

    return inputs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """Learns from the rows whose fold is not ``held_out`` and predicts every row: id, held_out, lang_pred, score."""
    fold = remainder(id_col, folds)
    model = fit(docs.where(fold != held_out), text_col, lang_col)
    out = predict(docs, model, id_col, text_col)
    return out.select(id_col, (remainder(id_col, folds) == held_out).alias("held_out"), "lang_pred", "score")


def rejected(lang_pred: Column, score: Column, least: float = 0.3) -> Column:
    """Whether a filter by language drops a document: no language, or hardly any evidence for one."""
    return (lang_pred == UNKNOWN) | (score < least)
