"""Every operator against a plain version, on texts with all that may go wrong."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rowloom.llm import html_extract, language_id, line_dedup, mixing, near_dedup, ngram_lm, quality_rules, sentencepieces, substring_dedup, topk_search

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split((text or "").encode()) if w]


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage, line = prose(120), prose(45), "Read more on our site"
    out = [None, "", " \n\t ", "one", "two words", "ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab", "12 34 !!", "née x y \r\n z", "☃ 😀 \x00 ok"]
    out += [base, base, base.upper().lower(), "\n".join([prose(30), line, prose(20)])]
    for _ in range(12):
        w = base.split()
        w[r.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    for _ in range(10):
        out.append("\n".join([prose(r.randint(0, 60)), passage, line, prose(r.randint(0, 60)), "", line]))
    out += [prose(r.randint(1, 90)) for _ in range(15)]
    out.append(prose(9000))
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", "d", "e", "f", None][i % 7], len(t or ""), i, "x", "y", "z") for i, t in enumerate(texts)]
    clashing = "component_id long, _id string, n_lines string, ids string"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clashing}").repartition(3).cache()


@pytest.fixture(scope="module")
def odd(docs):
    """Rows that repeat others, and rows without an id."""
    return docs.unionByName(docs.where("doc_id in (3, 9, 20)")).unionByName(docs.where("doc_id in (9, 21)").withColumn("doc_id", F.lit(None).cast("long"))).cache()


def by_id(df):
    rows = df.collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def shingles(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates(docs, odd, texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    for block in (2048, 4):
        got = by_id(near_dedup.near_duplicates(docs, block=block))
        assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if find(i) == i]
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and all(r.kept and r.component_id is None for r in rows if r.doc_id is None)


def test_large_group_is_cut_into_blocks(spark):
    r = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(100)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    up = list(range(700))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(700):
        for j in range(i):
            x, y = sorted((find(i), find(j)))
            if x != y and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                up[y] = x
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=200))
    assert {i: x.component_id for i, x in got.items()} == {i: find(i) for i in range(700)}


def test_substrings(docs, odd, texts):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i] = (len(w), sum(gone), kept.decode())
    got = by_id(substring_dedup.dedup_substrings(docs))
    assert {i: (r.n_words, r.n_removed, r.kept_text) for i, r in got.items()} == want
    rows = substring_dedup.dedup_substrings(odd).collect()
    assert len(rows) == odd.count()
    assert all((r.n_words, r.n_removed, r.kept_text) == want[r.doc_id] for r in rows if r.doc_id is not None)


def test_suffix_automaton():
    r = random.Random(3)
    for _ in range(60):
        texts = [[r.randrange(3) for _ in range(r.randint(1, 25))] for _ in range(4)]
        a, flat = substring_dedup.SuffixAutomaton(), []
        for t in texts:
            for w in t:
                a.extend(w)
            a.restart()
            flat += [*t, None]
        query = [r.randrange(4) for _ in range(30)]
        for n in (1, 3, 5):
            want = [next((e for e in range(n - 1, len(flat)) if flat[e - n + 1 : e + 1] == query[i - n + 1 : i + 1]), -1) if i >= n - 1 else -1 for i in range(30)]
            assert a.first_ends(query, n) == want


def test_quality_measures(docs, odd, texts):
    got = by_id(quality_rules.score_quality(docs))
    for i, t in enumerate(texts):
        w = words(t)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        chars = sum(len(x.decode()) for x in w)
        want = (len(w), chars, sum((t or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    assert quality_rules.score_quality(odd).count() == odd.count()


def test_label_model_finds_bad_documents():
    import numpy as np

    r = np.random.default_rng(0)
    good = r.random(20_000) < 0.9
    votes = np.stack([np.where(good, np.where(r.random(20_000) < 0.005, -1, 1), np.where(r.random(20_000) < 0.4, -1, 1)) for _ in range(5)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.LabelModel.fit(patterns, counts.astype(float))
    assert 0.85 < model.good < 0.95
    assert ((model.likely[0, :, 0] > 0.2) & (model.likely[1, :, 0] < 0.02)).all()


def test_language_model(docs, odd, texts):
    tokens = [[w.lower() for w in words(t)] + ["END"] for t in texts]
    train = [t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["START", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    ahead, follow = collections.Counter(), collections.Counter()
    for (a, _), k in pairs.items():
        ahead[a] += k
        follow[a] += 1
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    got = by_id(ngram_lm.score_documents(docs, slice_bytes=4000, order=2))
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10(p1(w)) for w in t), abs=1e-6)
        exact = sum(math.log10(max(pairs[a, w] - 0.75, 0) / ahead[a] + 0.75 * follow[a] / ahead[a] * p1(w) if ahead[a] else p1(w)) for a, w in zip(["START", *t], t, strict=False))
        assert r.score == pytest.approx(exact, abs=0.03 * len(t))  # 8-bit probabilities
    assert ngram_lm.score_documents(odd).count() == odd.count()


def test_elias_fano():
    import numpy as np

    r = np.random.default_rng(2)
    for n, top in ((0, 10), (1, 1), (500, 600), (800, 1 << 40), (300, 1 << 50)):
        values = np.sort(r.integers(0, top, n)).astype(np.uint64)
        e = ngram_lm.EliasFano.build(values, top)
        if n:
            assert (e.get(np.arange(n)) == values).all()
        asked = r.integers(0, top, 200).astype(np.uint64)
        assert (e.successor(asked) == np.searchsorted(values, asked)).all()


def test_language_identification(spark, docs, odd, texts):
    got = by_id(language_id.identify(docs))
    for i, t in enumerate(texts):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (got[i].lang_pred == "und") == (not any(ch.isalpha() for ch in t or ""))
        assert 0 <= got[i].score <= 1
    assert language_id.identify(odd).count() == odd.count()
    r = random.Random(7)
    parts = {"x": ["lor", "em", "ip", "sum", "dol"], "y": ["kra", "vet", "zun", "pol", "iki"]}
    rows = []
    for i in range(300):
        lang = "xy"[i % 2]
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(2)) for _ in range(8)), lang))
    told = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert sum(x.lang_pred == rows[x.doc_id][2] for x in told) >= 0.98 * len(told) > 0


def test_line_dedup(docs, odd, texts):
    sources = ["a", "b", "c", "d", "e", "f", None]
    sites, first = collections.defaultdict(set), {}
    strip = " \t\n\x0b\x0c\r"
    for i, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n") if t is not None else []):
            sites[x.strip(strip)].add(sources[i % 7])
            first.setdefault(x.strip(strip), (i, k))
    got = by_id(line_dedup.dedup_lines(docs))
    for i, t in enumerate(texts):
        lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(lines) if not x.strip(strip) or len(sites[x.strip(strip)]) < 5 or first[x.strip(strip)] == (i, k)]
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == ("\n".join(kept) if t is not None else None, len(lines), len(lines) - len(kept))
        assert got[i].component_id == i and got[i]._id == "x"
    assert sum(r.n_removed for r in got.values()) > 10
    assert line_dedup.dedup_lines(odd).count() == odd.count()


def test_mixing(spark, docs, odd, texts):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 40), "s0" if r.random() < 0.4 else r.choice(["s1", "s2", "s3", None]), ) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(mixing.pareto_mix(df))
    again = by_id(mixing.pareto_mix(df.repartition(7)))
    assert {i: x.taken for i, x in got.items()} == {i: x.taken for i, x in again.items()}
    total = sum(x.size for x in got.values())
    sizes = collections.Counter()
    taken = collections.Counter()
    for i, text, source in rows:
        assert got[i].size == len(text.split()) and got[i].taken % max(got[i].size, 1) == 0 and got[i].taken <= 3 * got[i].size
        sizes[source] += got[i].size
        taken[source] += got[i].taken
    weights = dict(zip(["s0", "s1", "s2", "s3", None], [1, 2, 3, 1, 2], strict=True))
    target, open_ = {}, set(weights)
    while True:  # cap, and share the rest again
        left = total - sum(3 * sizes[s] for s in weights if s not in open_)
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        open_ -= over
    target = {s: share[s] if s in open_ else 3 * sizes[s] for s in weights}
    for i, _, source in rows:
        assert got[i].target == pytest.approx(target[source]) and got[i].source_size == sizes[source]
    for s in weights:
        assert abs(taken[s] - target[s]) <= 20
    assert mixing.pareto_mix(odd).count() == odd.count()
    assert mixing.mixed(docs).columns == docs.columns


def test_sentencepieces(docs, odd, texts):
    model = sentencepieces.PieceModel.load()

    def best(text):  # the best score of any segmentation
        data = b" " + text.encode()
        score = [0.0] + [-math.inf] * len(data)
        for i in range(len(data)):
            if score[i] == -math.inf or data[i] & 0xC0 == 0x80:
                continue
            for n, piece in model.trie.prefixes(data, i):
                score[i + n] = max(score[i + n], score[i] + model.score[piece])
            width = len(data[i:].decode()[0].encode())
            score[i + width] = max(score[i + width], score[i] + model.floor)
        return score[-1]

    got = by_id(sentencepieces.encode_documents(docs.select("doc_id", "text")))
    for i, t in enumerate(texts):
        assert got[i].round_trip and got[i].n_tokens == len(got[i].ids)
        assert model.decode(got[i].ids) == (t or "")
        if t and len(t) < 1500:
            ids = model.encode(t)
            assert ids == got[i].ids
            bytes_ = sum(x in set(model.byte_ids) for x in ids)
            if not bytes_:
                assert sum(model.score[x] for x in ids) == pytest.approx(best(t))
    decoded = by_id(sentencepieces.decode_documents(sentencepieces.encode_documents(docs.select("doc_id", "text"))))
    assert all(decoded[i].decoded == (t or "") for i, t in enumerate(texts))
    assert sentencepieces.encode_documents(odd).count() == odd.count()


def test_trie():
    items = {b"a": 1, b"ab": 2, b"abc": 3, b"b": 4, b"\xff\x00": 5, b"ca": 6}
    t = sentencepieces.DoubleArrayTrie(items)
    assert list(t.prefixes(b"abcd", 0)) == [(1, 1), (2, 2), (3, 3)]
    assert list(t.prefixes(b"xca", 1)) == [(2, 6)]
    assert list(t.prefixes(b"\xff\x00", 0)) == [(2, 5)] and not list(t.prefixes(b"c", 0))


def test_search(docs, odd, texts):
    sets = [collections.Counter(w.lower() for w in words(t)) for t in texts]
    n, mean = len(sets), sum(sum(s.values()) for s in sets) / len(sets)
    df = collections.Counter(w for s in sets for w in s)
    idf = lambda w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
    found = collections.defaultdict(list)
    for r in topk_search.search(docs, F.col("doc_id") % 2 == 0, k=7).collect():
        found[r.query_id].append((r.rank, r.doc_id, r.score))
    for q in range(0, n, 2):
        scores = {d: sum(idf(w) * s[w] * 2.2 / (s[w] + 1.2 * (0.25 + 0.75 * sum(s.values()) / mean)) for w in sets[q] if w in s) for d, s in enumerate(sets)}
        want = sorted(((-round(x, 9), d) for d, x in scores.items() if x > 0))[:7]
        assert [d for _, d, _ in sorted(found[q])] == [d for _, d in want]
        assert [x for _, _, x in sorted(found[q])] == pytest.approx([-x for x, _ in want])
    assert topk_search.search(odd, F.col("doc_id") == 9, k=3).count() == 3


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>"</p>"</script></head><body>
<div id="top-banner">Buy &amp; save</div><nav><ul><li><a href="/a">A {n}</a></ul></nav><div class="notice">Same for all</div><div>{extra}</div>
<article class="post"><header><h1>Title {n}</h1></header><p>First &lt;{n}&gt; <b>bold</b>
 text<p>Second&nbsp;part {n}<br>goes on<div class="share-buttons">Share</div></p><blockquote>Said {n}</blockquote>
<form><input name=q><button>Go</button></form></article><section class="comments"><article>Me too {n}</article></section>
<aside>Side {n}</aside><footer>&copy; {n}</footer></body>"""


def test_html(spark):
    rows = [(i, f"https://User@h{i % 2}.example:8080/{i}?x", PAGE.format(n=i, extra="")) for i in range(8)]
    rows += [(100, None, None), (101, "x", ""), (102, "https://h0.example/t", "<p>only &am"), (103, "https://h0.example/d", "<div>" * 3000 + "deep"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_url", F.lit(1)).withColumn("text", F.lit("old")).repartition(3)
    got = {r.page_id: r for r in html_extract.extract_text(df).collect()}
    for i in range(8):
        assert got[i].text == f"Title {i}\nFirst <{i}> bold text\nSecond part {i} goes on\nSaid {i}"
        assert got[i].n_chars == len(got[i].text) and got[i]._url == 1
    assert (got[100].text, got[101].text, got[102].text, got[103].text) == ("", "", "only &am", "deep")
    assert html_extract.extract_text(df).count() == len(rows)


def test_wrapper_tells_template_from_content(spark):
    page = "<html><body><div><p>Our shop, open daily</p></div><section><div><p>News {n}</p><p>More {n}</p></div></section></body></html>"
    rows = [(i, f"http://one.example/{i}", page.format(n=i)) for i in range(6)]
    got = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"News {r.page_id}\nMore {r.page_id}" for r in got)


def test_tree_matching():
    from rowloom.llm.html_extract import Shape, align, match

    tree = lambda label, *kids: Shape(label, kids=list(kids))
    a = tree("r", tree("b", tree("c")), tree("d"), tree("e"))
    b = tree("r", tree("d"), tree("b", tree("c"), tree("x")), tree("e"))
    assert match(a, b, {})[0] == 4  # r, b, c, e
    placed = align(a, b, True)
    assert [p.label for p in placed] == [s.label for s in b.preorder()]
    assert [k.label for k in a.kids] == ["d", "b", "d", "e"]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize(
    "run",
    [
        near_dedup.near_duplicates, near_dedup.without_near_duplicates, quality_rules.score_quality, ngram_lm.score_documents, line_dedup.dedup_lines,
        substring_dedup.dedup_substrings, mixing.pareto_mix, mixing.mixed, sentencepieces.encode_documents, language_id.identify, lambda d: topk_search.search(d, F.col("doc_id") % 20 == 0),
    ],
)
def test_empty_table(spark, run):
    assert run(empty(spark)).collect() == []


def test_no_pages(spark):
    assert html_extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_digest_of_kept_text(spark, docs, texts):
    got = by_id(substring_dedup.dedup_substrings(docs).select("doc_id", "kept_text", F.sha2("kept_text", 256).alias("h")))
    assert all(r.h == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got.values())
