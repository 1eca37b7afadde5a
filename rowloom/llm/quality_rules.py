"""Quality rules as weak supervision: rules vote or abstain, and EM weighs the rules.

Every rule looks at one document and votes good (1), bad (-1) or nothing (0). A latent label explains the votes:
rule j votes v on a document of label y with probability a_jyv. EM over the *counts of vote patterns* (at most 3**rules
of them, however many documents there are) estimates these and the share of good documents; a document's posterior
probability then replaces the usual demand that all rules pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import grams, inside, mix, powers, slices, space_mask, word_hashes, words
from .shared import small_batches, stored

SYMBOLS = b"#*$%&|<>"
TERMINAL = b".!?\"')"
WINDOW = 5

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_word_lines", "n_ended_lines", "n_digits",
    "n_upper", "n_letters", "n_exclaims",
]


def measure(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """The MEASURES of every text of a column, slice by slice; a null text counts as an empty one."""
    for s in slices(column):
        w = words(s)
        data, n = s.data, len(s)
        per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[s.offsets])
        solid = ~space_mask(data)
        letters = (((data | 32) >= 97) & ((data | 32) <= 122)) | (data >= 0x80)
        letter_sum = np.concatenate([[0], np.cumsum(letters)])
        out = {
            "n_words": w.counts,
            "word_chars": per_doc(solid & ((data & 0xC0) != 0x80)),
            "n_symbols": per_doc(np.isin(data, np.frombuffer(SYMBOLS, np.uint8))),
            "n_letter_words": np.bincount(w.doc, letter_sum[w.end] > letter_sum[w.start], n).astype(np.int64),
            "n_digits": per_doc((data >= 48) & (data <= 57)),
            "n_upper": per_doc((data >= 65) & (data <= 90)),
            "n_letters": per_doc(((data | 32) >= 97) & ((data | 32) <= 122)),
            "n_exclaims": per_doc(data == 33),
        }
        # lines: a start after each \n and at each text's start, an end at each \n and at each text's end
        breaks = np.flatnonzero(data == 10)
        start = np.sort(np.concatenate([s.offsets[:-1], breaks + 1]))
        end = np.sort(np.concatenate([breaks, s.offsets[1:]]))
        doc = np.repeat(np.arange(n), per_doc(data == 10) + 1)
        solid_sum = np.concatenate([[0], np.cumsum(solid)])
        full = solid_sum[end] > solid_sum[start]
        start, end, doc = start[full], end[full], doc[full]
        out["n_word_lines"] = np.bincount(doc, minlength=n)
        out["n_ended_lines"] = np.bincount(doc, np.isin(data[end - 1], np.frombuffer(TERMINAL, np.uint8)) if len(end) else None, n).astype(np.int64)
        keys = mix(_span_hashes(data, start, end) ^ mix(doc.astype(np.uint64)))
        _, firsts = np.unique(keys, return_index=True)
        out["n_dup_lines"] = out["n_word_lines"] - np.bincount(doc[firsts], minlength=n)
        # words in windows that stand twice or more in their text
        at = inside(w, WINDOW)
        keys = mix(grams(word_hashes(data, w), WINDOW)[at] ^ mix(w.doc[at].astype(np.uint64)))
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        at = at[count[back] > 1]
        covered = np.zeros(len(w) + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
        covered = np.cumsum(covered)[:-1] > 0
        out["n_repeat_words"] = np.bincount(w.doc, covered, n).astype(np.int64)
        yield out


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    base = 0x9E3779B97F4A7C15
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=total[1:])
    return (total[end] - total[start]) * powers(pow(base, -1, 1 << 64), len(data) + 1)[start]


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(value: Column, bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules over MEASURES: name -> vote in -1, 0, 1."""
    length, symbols = _ratio("word_chars", "n_words"), _ratio("n_symbols", "n_words")
    copied, repeated = _ratio("n_dup_lines", "n_word_lines"), _ratio("n_repeat_words", "n_words")
    lettered, ended, digits = _ratio("n_letter_words", "n_words"), _ratio("n_ended_lines", "n_word_lines"), _ratio("n_digits", "word_chars")
    upper, shouted = _ratio("n_upper", "n_letters"), _ratio("n_exclaims", "n_words")
    never = F.lit(False)
    return {
        "word_count": _vote(F.col("n_words"), F.col("n_words") < 10, F.col("n_words") >= 50),
        "word_length": _vote(length, (length < 2) | (length > 15), (length >= 3.5) & (length <= 8)),
        "symbols": _vote(symbols, symbols > 0.1, symbols <= 0.02),
        "copied_lines": _vote(copied, copied > 0.5, copied <= 0.1),
        "repeated_words": _vote(repeated, repeated > 0.2, repeated <= 0.1),
        "letters": _vote(lettered, lettered < 0.6, lettered >= 0.9),
        "line_ends": _vote(ended, never, ended >= 0.5),
        "digits": _vote(digits, digits > 0.6, digits <= 0.1),
        "capitals": _vote(upper, (upper > 0.5) & (F.col("n_letters") >= 20), upper <= 0.2),
        "exclaims": _vote(shouted, shouted > 0.3, shouted <= 0.1),
    }


@dataclass
class LabelModel:
    """What each vote says about a document: its likelihood given a good document over that given a bad one."""

    good: float  # share of good documents
    ratios: np.ndarray  # rules x (bad vote, no vote, good vote): log likelihood ratios
    likely: np.ndarray  # label (bad, good) x rules x vote
    rounds: int = 0

    #: Imagined votes behind each rule, as shares of all documents: they decide where the data say nothing.
    PRIOR = np.array([[0.15, 0.10, 0.75], [0.002, 0.098, 0.90]])
    STRENGTH = 0.01

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
        """EM over distinct vote patterns (rows of -1, 0, 1) and how often each occurs.

        A rule's accuracy is estimated for each label, since a bad vote on a good document is much rarer than a good
        vote on a bad one. So that the labels keep their meaning, a bad vote speaks against a document by a factor of
        5 to 200, a good vote for it by 1 to 1.3, and an abstention by at most 2 either way.
        """
        votes = np.stack([(patterns == v) for v in (-1, 0, 1)], 2).astype(float)  # pattern x rule x vote
        total = max(float(counts.sum()), 1.0)
        imagined = np.array([0.2, 0.8])[:, None, None] * cls.PRIOR[:, None, :] * (cls.STRENGTH * total + 1)
        likely, good, done = np.repeat(cls.PRIOR[:, None, :], patterns.shape[1], 1), 0.8, 0
        low, high = np.log([1 / 200, 1 / 2, 1]), np.log([1 / 5, 2, 1.3])
        while True:
            ratios = np.clip(np.log(likely[1]) - np.log(likely[0]), low, high)
            done += 1
            p = 1 / (1 + np.exp(-(math.log(good / (1 - good)) + (votes * ratios).sum((1, 2)))))
            held = np.stack([(1 - p) * counts, p * counts])
            likely = np.einsum("lp,prv->lrv", held, votes) + imagined
            likely /= likely.sum(2, keepdims=True)
            share = float(np.clip((held[1].sum() + 8) / (counts.sum() + 10), 0.5, 0.99))
            if abs(share - good) < tolerance or done == rounds:
                return cls(share, ratios, likely, done)
            good = share

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a document is good, as an expression over its votes."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for vote, (bad, none, good) in zip(votes, self.ratios.tolist(), strict=True):
            odds = odds + F.when(vote < 0, bad).when(vote > 0, good).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and MEASURES of every document, as long; one row a row."""
    schema = ", ".join([f"{id_col} long", *(f"{m} long" for m in MEASURES)])

    def run(batches):
        for batch in batches:
            at = 0
            for out in measure(batch.column(1)):
                n = len(out["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), *(pa.array(out[m].astype(np.int64)) for m in MEASURES)], [id_col, *MEASURES]
                )
                at += n

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, schema)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Measures, votes and posterior of every document.

    Returns ``id_col``, MEASURES, ``vote_<rule>`` for every rule, ``posterior`` (double), ``base_failed`` and ``kept``.
    ``base_failed`` is a fixed floor (fewer than 10 words, or over a fifth of them in repeated windows), which no
    vote overrules; else a document is kept if its posterior is at least ``threshold``.

    A null text counts as empty, so it is base_failed; a null id stays null; repeated rows each get a row; an empty
    table gives an empty result; other columns are not looked at. Ties at the threshold are kept.
    """
    small_batches(docs.sparkSession)
    votes = rules()
    names = [f"vote_{n}" for n in votes]
    table = stored(measured(docs, id_col, text_col).select("*", *(v.alias(f"vote_{n}") for n, v in votes.items())), "votes")
    patterns = table.groupBy(*names).count().collect()  # at most 3 ** rules rows
    model = LabelModel.fit(
        np.array([r[:-1] for r in patterns], np.int64).reshape(-1, len(names)), np.array([r[-1] for r in patterns], np.float64)
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        table.withColumn("posterior", model.posterior([F.col(n) for n in names]))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )
