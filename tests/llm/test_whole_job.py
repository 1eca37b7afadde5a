"""Cases in which an operator once did less than the whole job."""

import collections
import math
import random
import zlib

import corpus_pipeline
import test_pipeline
import pytest
from rowloom.llm import html_extract, near_dedup, ngram_lm, sentencepieces


def pairs(n, edits, seed=1):
    """Texts of 100 words, and after each a copy in which ``edits`` words far from each other differ: 5 shingles a word."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{r.randrange(10**9)}" for _ in range(100)]
        rows.append((2 * i, " ".join(w)))
        for k in range(edits):
            w[10 + 80 * k // edits] = "edit"
        rows.append((2 * i + 1, " ".join(w)))
    return rows


def test_pipeline_drops_near_copies_from_0_8(spark):
    rows = [(i, t, "en", "a", len(t)) for i, t in pairs(60, 2)]  # 86 of 106 shingles: 0.811
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 120, 2))


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near(rows):
    """Documents without a near copy of a smaller id, by all pairs at 0.8."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    sets, up = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return [r for i, r in enumerate(rows) if find(i) == i]


def test_pipeline_against_plain_stages_at_0_8(spark, folder):
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    for plain in (test_pipeline.language, test_pipeline.lines, near, test_pipeline.mix):
        rows = list(plain(rows))
    model = sentencepieces.PieceModel.load()
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r["doc_id"], r["text"]) for r in rows)
    assert all(r.round_trip and model.decode(r.ids) == r.text and r.n_tokens == len(r.ids) for r in got)


def test_language_model_keeps_slices_of_equal_rows(spark):
    rows = [(i, f"a b{i} c{i % 3} a") for i in range(20)]
    twice = spark.createDataFrame(spark.sparkContext.parallelize(rows * 2, 2), "doc_id long, text string")  # equal partitions
    got = ngram_lm.score_documents(twice).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in rows * 2 if not held(i) for w in [*t.split(), "END"])
    n, v = sum(c.values()), len(c)
    assert sorted(r.doc_id for r in got) == sorted(2 * [i for i, _ in rows])
    for r in got:
        w = [*rows[r.doc_id][1].split(), "END"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (5, sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), abs=1e-6)


def extracted(spark, pages):
    rows = [(i, f"http://one.example/{i}", x) for i, x in enumerate(pages)]
    got = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_article_copies_under_differing_menus(spark):
    page = "<body><div><p>Menu {n}</p></div><article><h1>{h}</h1><p>{p}</p></article><div><p>Foot {n}</p></div></body>"
    assert extracted(spark, [page.format(n=i, h="Title", p="Same text") for i in range(5)]) == ["Title\nSame text"] * 5
    # three copies on a larger host, and one heading on all pages
    texts = ["Same text"] * 3 + [f"Text {i}" for i in range(6)]
    assert extracted(spark, [page.format(n=i, h="Title", p=t) for i, t in enumerate(texts)]) == [f"Title\n{t}" for t in texts]


def test_class_names_that_only_mention_furniture(spark):
    kept = ['article class="post with-sidebar"', 'div id="content" class="no-menu"', 'article class="entry comment-open"', 'div class="story hasBanner"']
    gone = ['div class="sidebar"', 'article class="comment"', 'div class="post-navigation"', 'div class="share-buttons"', 'div class="content ad"']
    page = "<body><p>First {n}</p><{tag}><p>Text {n}</p></{end}></body>"
    texts = extracted(spark, [page.format(n=i, tag=x, end=x.split()[0]) for i, x in enumerate(kept + gone)])
    assert all(t.endswith(f"Text {i}") for i, t in enumerate(texts[: len(kept)]))
    assert texts[len(kept) :] == [f"First {i + len(kept)}" for i in range(len(gone))]


def test_near_copies_at_lower_thresholds(spark):
    docs = spark.createDataFrame(pairs(200, 5), "doc_id long, text string")  # 71 of 121 shingles: 0.587
    got = near_dedup.near_duplicates(docs, percent=55).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got) and len(got) == 400
    for percent in (0, 20, 32, 101):
        with pytest.raises(ValueError):
            near_dedup.near_duplicates(docs, percent=percent)
