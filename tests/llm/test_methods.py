"""The methods themselves: what each operator decides with its method switched off, and rows that share an id or have none."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import html_extract, language_id, line_dedup, mixing, near_dedup, ngram_lm, quality_rules, sentencepieces, substring_dedup, topk_search

SPACE = " \t\n\x0b\x0c\r"


def prose(r, n, words=200):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


# rows that share an id, or have none


@pytest.fixture(scope="module")
def shared(spark):
    """Different texts under one id, texts without an id, a row that is there twice, and a megabyte of text."""
    r = random.Random(11)
    passage, line = prose(r, 40, 10**6), "Read more on our site"
    rows = [(1, passage, "a"), (None, "x y " + passage, "b"), (None, prose(r, 40, 10**6), "c"), (7, prose(r, 40, 10**6), "a"), (7, prose(r, 40, 10**6), "b")]
    rows += [(3, f"keep\n{line}", "a"), (3, f"other\nunique second line\n{line}", "b"), (3, f"other\nunique second line\n{line}", "b")]
    rows += [(10 + i, f"{line}\nown {i} " + prose(r, 12, 10**6), "abcdef"[i]) for i in range(6)]
    rows += [(20, "z" * 1_100_000, "a"), (21, prose(r, 150_000, 10**5), None), (None, None, None), (None, "", "a"), (22, passage, "f")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).cache()


def of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_substrings_of_shared_ids(shared):
    rows, docs = shared
    hashed = {i: v for i, v in enumerate(r.h for r in docs.sparkSession.createDataFrame([(i, *x[:2]) for i, x in enumerate(rows)], "n int, doc_id long, text string").orderBy("n").select(F.xxhash64("doc_id", "text").alias("h")).collect())}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] if rows[i][0] is not None else 1 << 63, hashed[i]))
    seen, want, done = {}, [], {}
    for i in order:
        if (rows[i][0], rows[i][1]) in done:  # a row that is there twice is one document
            want.append(done[rows[i][0], rows[i][1]])
            continue
        w = (rows[i][1] or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone[k : k + 20] = [True] * 20
            seen[tuple(w[k : k + 20])] = True
        want.append((rows[i][0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
        done[rows[i][0], rows[i][1]] = want[-1]
    assert of(substring_dedup.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept_text") == sorted(want, key=repr)


def test_lines_of_shared_ids(shared):
    rows, docs = shared
    line = "Read more on our site"
    got = of(line_dedup.dedup_lines(docs), "doc_id", "text")
    want = []
    for i, text, _ in rows:
        kept = text
        if text is not None and line in text and i != 1 and i not in (None,):
            kept = "\n".join(x for x in text.split("\n") if x != line)
        want.append((i, kept))
    # the first occurrence is in one of the rows of id 3, by a hash of its text; rows equal in all are one document
    first = [(i, t) for i, t in got if i == 3 and line in t]
    assert len(set(first)) == 1
    mine = lambda x: sorted(((i, (t or "").replace("\n" + line, "")) if i == 3 else (i, t) for i, t in x), key=repr)
    assert mine(got) == mine(want)


def test_near_copies_of_shared_ids(shared):
    rows, docs = shared
    got = of(near_dedup.near_duplicates(docs), "doc_id", "component_id", "kept")
    # the passage under id 22 is a copy of that under id 1; nothing else is linked
    assert got == sorted(((i, None if i is None else 1 if i == 22 else i, i != 22) for i, _, _ in rows), key=repr)
    kept = of(near_dedup.without_near_duplicates(docs), "doc_id", "text", "source")
    want = [x for x in dict.fromkeys(x for x in rows if x[0] is not None and x[0] != 22)] + [x for x in rows if x[0] is None]
    assert kept == sorted(want, key=repr)


def test_mix_of_shared_ids(shared):
    rows, docs = shared
    told = collections.Counter()
    for r in mixing._drawn(docs, "doc_id", "source", "text", 3, "mix", None).collect():
        told[r.doc_id, r.digest] += r.copies
    mixed = collections.Counter((r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) for r in mixing.mixed(docs).collect())
    assert {k: v for k, v in told.items() if v} == dict(mixed)


def test_others_judge_rows_by_their_texts(spark, shared):
    rows, docs = shared
    of_text = lambda df, *names: of(df, "doc_id", *names)
    numbered = spark.createDataFrame([(100 + i, *x[1:]) for i, x in enumerate(rows)], "doc_id long, text string, source string")
    back = {100 + i: x[0] for i, x in enumerate(rows)}
    renamed = lambda found: sorted(((back[x[0]], *x[1:]) for x in found), key=repr)
    for run, names in (
        (quality_rules.score_quality, ["n_words", "n_dup_lines", "n_repeat_words", "kept"]),
        (lambda d: sentencepieces.encode_documents(d.select("doc_id", "text")), ["n_tokens", "round_trip", "ids"]),
        (lambda d: language_id.predict(d, language_id.LanguageFilter.build(["x"], np.array([1], np.uint32), np.ones((1, 1), bool))), ["lang_pred", "score"]),
    ):
        assert of_text(run(docs), *names) == renamed(of_text(run(numbered), *names))


# op1: the wrapper


UNMARKED = """<html><body><div><a href=/{n}>Menu {n}</a> <a href=/x>Things {n} to read</a></div><div>Offer {m} of the week</div>
<div><h1>Title {n}</h1><p>First {n} {p}</p><p>Second {n} {p}</p><ul><li>Point {n} {p}</li><li>More {n}</li></ul></div><div>Written for host {n}</div></body></html>"""


def texts(spark, pages, **more):
    df = spark.createDataFrame([(i, f"http://one.example/{i}", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(html_extract.extract_text(df, **more).collect(), key=lambda r: r.page_id)]


def test_unmarked_pages_need_the_wrapper(spark, monkeypatch):
    pages = [UNMARKED.format(n=i, m=i % 3, p="word " * (10 + i)) for i in range(9)]
    tidy = lambda i: " ".join(["word"] * (10 + i))
    want = [f"Title {i}\nFirst {i} {tidy(i)}\nSecond {i} {tidy(i)}\nPoint {i} {tidy(i)}\nMore {i}" for i in range(9)]
    assert texts(spark, pages) == want
    wrapper = html_extract.Wrapper()  # one that has learned nothing
    assert wrapper.extract(html_extract.parse(pages[0])) != want[0]


def test_all_articles_stay_and_both_branches_agree(spark, monkeypatch):
    page = "<body><nav>N {n}</nav><article><p>One {n} and some words</p></article><article><p>Two {n}</p></article><footer>F {n}</footer></body>"
    pages = [page.format(n=i) for i in range(5)]
    want = [f"One {i} and some words\nTwo {i}" for i in range(5)]
    assert texts(spark, pages) == want
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert texts(spark, pages) == want


# op2: coordinates


def test_merger_counts_collisions():
    r = np.random.default_rng(1)
    sig = r.integers(0, 4, (60, 32)).astype(np.uint64)
    sig[10:20] = sig[5]
    sig[12, :10] = 99
    for least in (1, 8, 14, 32):
        m = near_dedup.Merger(sig, least)
        for i in range(60):
            want = [j for j in range(60) if j != i and (sig[i] == sig[j]).sum() >= least]
            assert m.agreeing(i).tolist() == want


def test_minima_have_64_bits():
    keys = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 3000).astype(np.uint64))
    sig = near_dedup.signatures(keys, np.arange(0, 3001, 3))
    assert sig.dtype == np.uint64 and all(len(np.unique(sig[:, k])) == 1000 for k in range(32))


# op4: orders


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders(spark, order):
    r = random.Random(order)
    rows = [(i, prose(r, r.randint(0, 30), 12)) for i in range(60)] + [(60, None)]
    tokens = [[*(t or "").split(), "END"] for _, t in rows]
    train = [t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    seen, after, follow = (collections.Counter() for _ in range(3))
    padded = lambda t: ["START"] * (order - 1) + t
    for t in train:
        x = padded(t)
        for i, k in itertools.product(range(order - 1, len(x)), range(1, order)):
            u = tuple(x[i - k : i])
            seen[u, x[i]] += 1
            after[u] += 1
            follow[u] += seen[u, x[i]] == 1

    def p(u, w):
        if not u:
            return (c[w] + 0.1) / (n + 0.1 * (v + 1))
        if not after[u]:
            return p(u[1:], w)
        return max(seen[u, w] - 0.75, 0) / after[u] + 0.75 * follow[u] / after[u] * p(u[1:], w)

    got = {x.doc_id: x for x in ngram_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), slice_bytes=300, order=order).collect()}
    for i, t in enumerate(tokens):
        x = padded(t)
        exact = sum(math.log10(p(tuple(x[j - order + 1 : j]), x[j])) for j in range(order - 1, len(x)))
        assert got[i].score == pytest.approx(exact, abs=0.04 * len(t)) and got[i].train_tokens == n and got[i].n_known == sum(c[w] > 0 for w in t)


def test_squeezing():
    for kind in (np.uint8, np.uint32, np.uint64):
        x = np.random.default_rng(3).integers(0, 200, 1000).astype(kind)
        assert (ngram_lm.unsqueezed(ngram_lm.squeezed(x), kind) == x).all() and len(ngram_lm.unsqueezed(ngram_lm.squeezed(x[:0]), kind)) == 0


def test_quantised_numbers_reach_as_far_as_the_corpus():
    for tokens in (0, 1, 10**6, 10**12, 10**16):
        step = ngram_lm.step_for(tokens)
        p = np.array([1.0, 0.5, 0.25 / max(tokens, 1), 0.0])
        back = ngram_lm.decoded(step)[ngram_lm.quantise(p, step)]
        assert back[3] == 0 and np.abs(np.log10(back[:3] / p[:3])).max() <= step / 2 + 1e-9
    assert ngram_lm.step_for(10**6) == ngram_lm.DECADES / 254


# op7: automata


def plain_removed(rows):
    seen, want = set(), {}
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(tuple(w[k : k + 20]))
        want[i] = sum(gone)
    return want


def test_automata_decide(spark, monkeypatch):
    r = random.Random(5)
    passages = [prose(r, n, 10**6) for n in (25, 40, 60)]
    rows = [(i, " ".join([prose(r, r.randint(0, 9), 10**6), *r.sample(passages, r.randint(1, 3)), prose(r, r.randint(0, 9), 10**6)])) for i in range(60)] + [(60 + i, rows_) for i, rows_ in enumerate([passages[1]] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lambda: {x.doc_id: x.n_removed for x in substring_dedup.dedup_substrings(docs).collect()}
    want = plain_removed(rows)
    assert found() == want and sum(want.values()) > 1000
    # salted classes
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    assert found() == want


def test_shards_are_bounded():
    """A key whose contents fill many shards, against one automaton of all."""
    r = random.Random(9)
    body = np.array([r.randrange(3) for _ in range(4000)], np.uint32)
    begin = np.array(sorted(r.randrange(3900) for _ in range(80)))
    size = np.array([r.randint(8, 60) for _ in begin])
    key = np.array([5] * 50 + [9] * 30, np.uint64)
    one, many = (substring_dedup.shards(key, begin, size, body, 6, n) for n in (10**6, 50))
    by_key = [substring_dedup.shards(key[x], begin[x], size[x], body, 6, 10**6) for x in (slice(0, 50), slice(50, 80))]
    assert many[1] == one[1]  # all windows are found, by themselves at least
    got = many[0]
    for i in range(50):
        assert got[i] == by_key[0][0][i]
    assert one[0][:50] == got[:50]


def test_without_automata_nothing_goes(monkeypatch):
    body = np.arange(100, dtype=np.uint32) % 30
    args = (np.full(3, 7, np.uint64), np.arange(3), np.arange(3), np.zeros(3, np.int64), np.full(3, 30, np.int64), np.array([True, False, False]))
    run = lambda: sum(len(x[0]) for x in substring_dedup.matched(*args, body[:90], 20, 1000))
    assert run() > 0
    monkeypatch.setattr(substring_dedup.SuffixAutomaton, "first_ends", lambda self, sequence, length: [-1] * len(sequence))
    assert run() == 0


# op8: inclusion


def test_inclusion_probabilities_differ_and_hold(spark):
    r = random.Random(6)
    rows = [(i, "w " * r.choice([3, 30, 300]), "ab"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.pareto_mix(docs).collect()
    part = {(x.source, x.size): x.p for x in got}
    assert len({p for (s, _), p in part.items() if s == "a"}) == 3
    taken, target = collections.Counter(), {}
    for x in got:
        taken[x.source] += x.taken
        target[x.source] = x.target
    assert all(abs(taken[s] - target[s]) <= 300 for s in "ab")
    # over many seeds a document is taken about in proportion to the binary digits of its size
    often, n = collections.Counter(), collections.Counter(len(t.split()) for _, t, s in rows if s == "a")
    for seed in range(30):
        for x in mixing.pareto_mix(docs, seed=f"s{seed}").where("source = 'a'").collect():
            often[x.size] += x.copies
    means = {k: often[k] / 30 / n[k] for k in n}
    assert means[3] / 2 == pytest.approx(means[30] / 5, rel=0.25) and means[300] / 9 == pytest.approx(means[30] / 5, rel=0.15)


# op9: an independent Viterbi, and pieces of one's own


def test_segmentation_against_plain_viterbi():
    r = random.Random(8)
    pieces = {" ": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, " a": -2.2, "ba": -4.0, "é": -3.0, "aé": -3.3, "abab": -5.0}
    text = [b""] + [p.encode() for p in pieces] + [bytes([i]) for i in range(256)]
    score = [0.0, *pieces.values(), *[0.0] * 256]
    model = sentencepieces.PieceModel(text, score, list(range(1 + len(pieces), 257 + len(pieces))), 0)
    floor = min(pieces.values()) - sentencepieces.UNKNOWN_PENALTY
    encoder = sentencepieces.Encoder(model)
    for _ in range(300):
        t = "".join(r.choice("ab é☃") for _ in range(r.randint(1, 12)))
        best = {0: 0.0}
        for i in range(len(t)):
            for n in range(1, 5):
                x = t[i : i + n]
                if x in pieces:
                    best[i + len(x)] = max(best.get(i + len(x), -1e9), best[i] + pieces[x])
            if t[i] not in pieces:
                best[i + 1] = max(best.get(i + 1, -1e9), best[i] + floor)
        data = np.frombuffer(t.encode(), np.uint8)
        ids, n = encoder.segment_all(data, np.array([0]), np.array([len(data)]))
        assert ids.tolist() == model.segment(t.encode()) and n.tolist() == [len(ids)]
        assert b"".join(model.text[i] for i in ids) == t.encode()
        unknown = sum(ch not in pieces for ch in t)
        assert sum(model.score[i] for i in ids) + unknown * floor == pytest.approx(best[len(t)])


# op10: exact sets instead of filters


def test_languages_against_exact_sets(spark):
    r = random.Random(4)
    parts = {"x": ["lor", "em", "ip", "sum"], "y": ["kra", "vet", "zun", "ip"], "z": ["ééa", "öko", "ñu", "em"]}
    rows = [(i, " ".join(r.choice(parts["xyz"[i % 3]]) + r.choice(parts["xyz"[i % 3]]) for _ in range(r.randint(1, 12))), "xyz"[i % 3] if i % 11 else None) for i in range(400)]
    rows += [(1000, "12 34", "x"), (1001, None, "y"), (1002, "", "y"), (1003, "ip", "x")]
    grams = lambda t: (lambda b: [b[k : k + 4] for k in range(len(b) - 3)])(b" " + t.lower().encode() + b" ")
    counts = collections.defaultdict(collections.Counter)
    for i, t, lang in rows:
        if lang and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(grams(t))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    top = collections.Counter()
    for s in share.values():
        for g, p in s.items():
            top[g] = max(top[g], p)
    own = {x: {g for g, p in s.items() if p >= 0.5 * top[g]} for x, s in share.items()}
    for x in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect():
        t = next(r_[1] for r_ in rows if r_[0] == x.doc_id)
        votes = {k: sum(g in s for g in grams(t)) for k, s in sorted(own.items())} if t and any(ch.isalpha() for ch in t) else {}
        if not votes:
            assert (x.lang_pred, x.score) == ("und", 0.0)
        elif sum(votes.values()):
            best = max(votes.values())
            assert votes[x.lang_pred] >= best - 0.51  # a filter's false positives may break a tie
            assert x.score == pytest.approx(best / sum(votes.values()), abs=0.05)


# op3: expectation-maximisation by hand


def test_posterior_against_plain_em():
    r = np.random.default_rng(3)
    patterns = np.array(list(itertools.product((-1, 0, 1), repeat=3)))
    counts = r.integers(1, 200, len(patterns)).astype(float)
    model = quality_rules.LabelModel.fit(patterns, counts, rounds=50)
    p = {tuple(x): 1 / (1 + math.exp(-(math.log(model.good / (1 - model.good)) + sum(model.ratios[j, v + 1] for j, v in enumerate(x))))) for x in patterns.tolist()}
    total = counts.sum()
    good = sum(c * p[tuple(x)] for x, c in zip(patterns.tolist(), counts))
    assert model.good == pytest.approx(min(max((good + 8) / (total + 10), 0.5), 0.99), abs=1e-3)
    for j, v in itertools.product(range(3), (-1, 0, 1)):
        own = sum(c * p[tuple(x)] for x, c in zip(patterns.tolist(), counts) if x[j] == v)
        prior = 0.8 * quality_rules.LabelModel.PRIOR[1][v + 1] * (quality_rules.LabelModel.STRENGTH * total + 1)
        norm = good + 0.8 * (quality_rules.LabelModel.STRENGTH * total + 1)
        assert model.likely[1, j, v + 1] == pytest.approx((own + prior) / norm, abs=2e-3)


# op5: ties


def test_ties_rank_by_id(spark):
    rows = [(i, "alpha beta") for i in range(40)] + [(100, "alpha"), (101, None), (102, " ")]
    got = topk_search.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), F.col("doc_id").isin(0, 101, 102), k=5)
    assert of(got, "query_id", "rank", "doc_id") == [(0, i + 1, i) for i in range(5)]
