"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Pieces and scores come from a model file, which the driver reads and broadcasts; its size is that of the vocabulary.
Texts are written with a space for the white-space marker. As no piece has a marker behind another character, the best
segmentation of a text is that of its stretches between such places, so each distinct stretch of a slice is segmented
once. All of them are segmented together: the trie is walked from all places at once, then the best scores of all
stretches advance end by end. Nothing is remembered from slice to slice, so a worker's memory is bounded by a slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Slice, Words, ragged, slices, word_hashes
from .shared import fresh, small_batches

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
UNKNOWN_TEXT = " ⁇ ".encode()
LONGEST = 512  # bytes of a stretch that is segmented beside others; longer ones go one by one


class DoubleArrayTrie:
    """Byte strings to values: from state s byte c leads to ``base[s] + c`` if ``check`` there is s."""

    def __init__(self, items: dict[bytes, int]):
        root: dict = {}
        for key, value in items.items():
            node = root
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = value
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free = 1  # where the search for room begins
        queue = [(0, root)]
        for state, node in queue:
            value[state] = node.get(-1, -1)
            bytes_ = sorted(b for b in node if b >= 0)
            if not bytes_:
                base[state] = -1
                continue
            at, seen = max(free, bytes_[0] + 1), 0
            begun = at
            while True:  # at: where the first byte's state may go
                if at + 256 >= len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                if check[at] >= 0:
                    seen += 1
                elif all(check[at + b - bytes_[0]] < 0 for b in bytes_[1:]):
                    break
                at += 1
            if seen >= 0.9 * (at - begun + 1):
                free = at  # what lies before is as good as full
            at -= bytes_[0]
            base[state] = at
            for b in bytes_:
                check[at + b] = state
                queue.append((at + b, node[b]))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))

    def walk(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in ``at``, length, value) of all items that ``data`` has at the places ``at`` and before ``end``, by rising length."""
        who, state, place, n = np.arange(len(at)), np.zeros(len(at), np.int32), at, 0
        while len(who):
            live = np.flatnonzero((place < end[who]) & (self.base[state] >= 0))
            who, state, place = who[live], state[live], place[live]
            to = self.base[state] + data[place]
            live = np.flatnonzero(self.check[to] == state)
            who, state, place = who[live], to[live], place[live] + 1
            n += 1
            found = self.value[state]
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                yield who[hit], np.full(len(hit), n), found[hit]

    def prefixes(self, text: bytes, at: int):
        """(length, value) of all items that ``text`` has at a place, shortest first."""
        base, check, value = self.base, self.check, self.value
        state = 0
        for n, byte in enumerate(text[at:], 1):
            to = int(base[state]) + byte
            if base[state] < 0 or check[to] != state:
                return
            state = to
            if value[state] >= 0:
                yield n, int(value[state])


def log_scores(scores: list[float]) -> list[float]:
    """Scores as log probabilities.

    Files of merge-based vocabularies hold 0, -1, -2, ... in the order of the pieces' ranks; by Zipf's law the
    probability of rank r is about in proportion to 1 / r. Other scores are log probabilities already.
    """
    if all(s <= 0 and s == int(s) for s in scores):
        return [-math.log1p(-s) for s in scores]
    return scores


@dataclass
class PieceModel:
    """A vocabulary: what each id stands for as bytes, its score, and the trie of the pieces that text can hold."""

    text: list[bytes]
    score: list[float]
    byte_ids: list[int]
    unknown: int
    dummy_prefix: bool = True
    trie: DoubleArrayTrie = field(init=False)
    _lists: tuple | None = field(init=False, default=None)

    @property
    def lists(self) -> tuple[list[int], list[int], list[int]]:
        """The trie's arrays as lists, which are faster to look at one by one; made when first asked for."""
        if self._lists is None:
            self._lists = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value))
        return self._lists

    def __post_init__(self) -> None:
        apart = {*self.byte_ids, self.unknown}
        held = {t: i for i, t in enumerate(self.text) if t and i not in apart}
        if any(b" " in t.lstrip(b" ") for t in held):
            raise ValueError("a piece has a white-space marker behind another character")
        self.trie = DoubleArrayTrie(held)
        self.floor = min((self.score[i] for i in held.values()), default=0.0) - UNKNOWN_PENALTY

    @classmethod
    def load(cls, path: str = MODEL_FILE) -> PieceModel:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        text, byte_ids = [], [-1] * 256
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                text.append(bytes([int(piece[3:5], 16)]))
            else:
                text.append(b"" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else piece.replace(MARKER, " ").encode())
        return cls(text, log_scores([p.get_score(i) for i in range(p.get_piece_size())]), byte_ids, p.unk_id())

    def segment(self, text: bytes) -> list[int]:
        """Ids of the best segmentation of a stretch; among equals the one whose last pieces are longest.

        A character that no piece stands for becomes its bytes, at a score below all pieces'.
        """
        n = len(text)
        best, back, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        (base, check, value), score = self.lists, self.score
        i = 0
        while i < n:
            lead = text[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, single, at = best[i], 0, False, i
            while at < n:
                to = base[state] + text[at]
                if base[state] < 0 or check[to] != state:
                    break
                state = to
                at += 1
                found = value[state]
                if found >= 0:
                    single |= at - i == width
                    if here + score[found] > best[at]:
                        best[at], back[at], piece[at] = here + score[found], i, found
            if not single and here + self.floor > best[min(n, i + width)]:
                end = min(n, i + width)
                best[end], back[end], piece[end] = here + self.floor, i, -1
            i += width
        out: list[int] = []
        at = n
        while at:
            i = back[at]
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.byte_ids[0] >= 0:
                out += [self.byte_ids[b] for b in reversed(text[i:at])]
            else:
                out.append(self.unknown)
            at = i
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        data = text.encode()
        if not data:
            return []
        return self.segment(b" " * self.dummy_prefix + data)

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; a byte sequence that isn't UTF-8 decodes to replacement characters."""
        data = b"".join(UNKNOWN_TEXT if i == self.unknown else self.text[i] for i in ids)
        if self.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


class Encoder:
    """Encodes slices of texts with a model."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.lengths = np.array([len(UNKNOWN_TEXT) if i == model.unknown else len(t) for i, t in enumerate(model.text)])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(UNKNOWN_TEXT if i == model.unknown else t for i, t in enumerate(model.text)), np.uint8)
        self.score = np.array(model.score, np.float64)

    def segment_all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``PieceModel.segment`` for all stretches [start, end) of ``data`` at once: ids in order, and how many each has."""
        model = self.model
        size = end - start
        n = len(size)
        text = data[ragged(start, size)]
        owner = np.repeat(np.arange(n), size)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        lead = np.flatnonzero((text & 0xC0) != 0x80)  # characters begin here
        width = np.diff(np.append(lead, len(text)))
        step = (lead - first[owner[lead]]).astype(np.uint16)
        order = np.argsort(step, kind="stable")
        lead, width, step = lead[order], width[order], step[order].astype(np.int64)
        # every stretch has one place more than bytes: where byte i of stretch k ends is place i + k + 1
        best = np.full(len(text) + n, -np.inf)
        zero = first + np.arange(n)
        best[zero] = 0
        back, by = np.zeros(len(best), np.int32), np.full(len(best), -1, np.int32)
        place = (lead + owner[lead]).astype(np.int32)
        single = np.zeros(len(lead), bool)
        matches = []
        for who, length, piece in model.trie.walk(text, lead, (first + size)[owner[lead]]):
            single[who[length == width[who]]] = True
            matches.append((step[who], place[who], place[who] + length.astype(np.int32), piece, self.score[piece]))
        bare = np.flatnonzero(~single)
        for w in np.unique(width[bare]).tolist():  # a character that no piece stands for
            own = bare[width[bare] == w]
            matches.append((step[own], place[own], place[own] + np.int32(w), np.full(len(own), -1, np.int32), np.full(len(own), model.floor)))
        # of one length and one first step a stretch has one match at most, so their ends differ
        cuts = [np.searchsorted(m[0], np.arange(int(step[-1]) + 2)).tolist() if len(step) else [] for m in matches]
        for k in range(int(step[-1]) + 1 if len(step) else 0):
            for (_, begin, until, piece, gain), cut in zip(matches, cuts, strict=True):
                a, b = cut[k], cut[k + 1]
                if a < b:
                    reach, to = best[begin[a:b]] + gain[a:b], until[a:b]
                    better = np.flatnonzero(reach > best[to])  # so among equals the longest last piece stays
                    to = to[better]
                    best[to], back[to], by[to] = reach[better], begin[a:b][better], piece[a:b][better]
        # from the ends back, all stretches a piece at a time
        at, live, done = zero + size, np.flatnonzero(size), np.zeros(n, np.int64)
        ids, of, slot = [], [], []
        while len(live):
            here = at[live]
            before, p = back[here], by[here]
            bare = np.flatnonzero(p < 0)
            if len(bare) and model.byte_ids[0] >= 0:  # the character's bytes, the last of them first
                gone, a, wide = live[bare], before[bare], (here - before)[bare]
                inner = ragged(np.zeros(len(bare), np.int64), wide)
                ids.append(np.array(model.byte_ids, np.int32)[text[np.repeat(a - gone, wide) + inner]])
                of.append(np.repeat(gone, wide)), slot.append(np.repeat(done[gone] + wide - 1, wide) - inner)
                done[gone] += wide
                known = np.flatnonzero(p >= 0)
            else:
                p = np.where(p < 0, model.unknown, p)
                known = np.arange(len(p))
            own = live[known]
            ids.append(p[known]), of.append(own), slot.append(done[own])
            done[own] += 1
            at[live] = before
            live = live[before > zero[live]]
        out = np.zeros(int(done.sum()), np.int32)
        ends = np.cumsum(done)
        for i, o, x in zip(ids, of, slot, strict=True):
            out[ends[o] - 1 - x] = i
        return out, done

    def marked(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The slice's texts with their leading space, and where each begins."""
        if not self.model.dummy_prefix:
            return s.data, s.offsets
        full = np.diff(s.offsets) > 0
        data = np.insert(s.data, s.offsets[:-1][full], np.uint8(32))
        return data, s.offsets + np.concatenate([[0], np.cumsum(full)])

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice in order, and where each text's begin."""
        data, offsets = self.marked(s)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(s) + 1, np.int64)
        begins = (data == 32) & np.concatenate([[True], data[:-1] != 32])
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        _, first, back = np.unique(word_hashes(data, Words(start, end, start, start)), return_index=True, return_inverse=True)
        first_start, first_end = start[first], end[first]
        short = first_end - first_start <= LONGEST
        sizes = np.zeros(len(first), np.int64)
        flat, sizes[short] = self.segment_all(data, first_start[short], first_end[short])
        at = np.zeros(len(first), np.int64)
        at[short] = np.concatenate([[0], np.cumsum(sizes[short])])[:-1]
        for i in np.flatnonzero(~short).tolist():
            ids = np.array(self.model.segment(data[first_start[i] : first_end[i]].tobytes()), np.int32)
            at[i], sizes[i] = len(flat), len(ids)
            flat = np.concatenate([flat, ids])
        ids = flat[ragged(at[back], sizes[back])]
        ends = np.concatenate([[0], np.cumsum(sizes[back])])
        return ids, ends[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, leading space included, and where each text's begin."""
        data = self.bytes[ragged(self.starts[ids], self.lengths[ids])]
        return data, np.concatenate([[0], np.cumsum(self.lengths[ids])])[cuts]


def encode_documents(docs: DataFrame, text_col: str = "text", model_file: str = MODEL_FILE, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all by default), ``ids`` (array<int>), ``n_tokens`` and ``round_trip``.

    ``round_trip`` says whether decoding the ids gives the text back; with byte fallback it always should.

    A null or empty text has no ids and makes the round trip; repeated rows each get a row; a column of ``docs`` that
    has the name of a result is replaced; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_file))
    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("ids", "n_tokens", "round_trip")]
    inputs = docs.select(*names, F.col(text_col).cast("string").alias(fresh(names, "_text")[0]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields[:-1]]

    def run(frames):
        encoder = Encoder(model.value)
        for batch in frames:
            for s in slices(batch.column(len(names))):
                ids, cuts = encoder.encode(s)
                back, at = encoder.decode(ids, cuts)
                data, offsets = encoder.marked(s)
                if len(back) == len(data) and np.array_equal(at, offsets):
                    wrong = np.diff(np.concatenate([[0], np.cumsum(back != data)])[offsets]) > 0
                else:
                    wrong = np.array([back[at[i] : at[i + 1]].tobytes() != data[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(s))], bool)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(s.first, len(s)) for i in range(len(names))), lists, pa.array(np.diff(cuts)), pa.array(~wrong)],
                    [*names, "ids", "n_tokens", "round_trip"],
                )

    return inputs.mapInArrow(run, ", ".join([*fields, "ids array<int>", "n_tokens long", "round_trip boolean"]))


def decode_documents(encoded: DataFrame, ids_col: str = "ids", model_file: str = MODEL_FILE, to: str = "decoded") -> DataFrame:
    """``encoded`` with a text column ``to`` made of its ids; null ids give a null, no ids an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(PieceModel.load(model_file))

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else model.value.decode([int(i) for i in x]))

    return encoded.withColumn(to, text(F.col(ids_col)))
