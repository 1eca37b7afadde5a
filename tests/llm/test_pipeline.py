"""The pipeline against a plain version of all its stages, on the smallest documents table."""

import collections
import hashlib
import zlib

import corpus_pipeline
from pyspark.sql import functions as F
from rowloom.llm import sentencepieces

SPACE = " \t\n\x0b\x0c\r"


def language(rows):
    """Documents that the first stage keeps: exact n-gram sets instead of filters."""
    grams = lambda t: (lambda b: [b[i : i + 4] for i in range(len(b) - 3)])(b" " + bytes(32 if x in b" \t\n\x0b\x0c\r" else x + 32 * (65 <= x <= 90) for x in t.encode()) + b" ")
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts[r["lang"]].update(grams(r["text"]))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    top = collections.Counter()
    for s in share.values():
        for g, p in s.items():
            top[g] = max(top[g], p)
    own = {x: {g for g, p in s.items() if p >= 1e-6 and p >= 0.5 * top[g]} for x, s in share.items()}
    for r in rows:
        votes = [sum(g in s for g in grams(r["text"])) for s in own.values()]
        if any(c.isalpha() for c in r["text"]) and sum(votes) and max(votes) / sum(votes) >= 0.3:
            yield r


def lines(rows):
    sites, first = collections.defaultdict(set), {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        for k, x in enumerate(r["text"].split("\n")):
            sites[x.strip(SPACE)].add(r["source"])
            first.setdefault(x.strip(SPACE), (r["doc_id"], k))
    for r in rows:
        kept = [x for k, x in enumerate(r["text"].split("\n")) if not x.strip(SPACE) or len(sites[x.strip(SPACE)]) < 5 or first[x.strip(SPACE)] == (r["doc_id"], k)]
        text = "\n".join(kept)
        if text == r["text"] or text.strip(SPACE):
            yield r | {"text": text, "n_chars": len(text) if text != r["text"] else r["n_chars"]}


def near(rows):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

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


def mix(rows):
    size = lambda r: len(r["text"].encode().split())
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += size(r)
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    open_, total = set(weights), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in weights if s not in open_)
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        open_ -= over
    digits = lambda r: size(r).bit_length() or 1
    for s in sorted(sizes):
        target = level * weights[s] if s in open_ else 3 * sizes[s]
        own = [r for r in rows if r["source"] == s]
        classes = collections.Counter()
        for r in own:
            classes[digits(r)] += size(r)
        # copies in proportion to the binary digits of the size, three at the most
        c = next((x for b in sorted(classes, reverse=True) if (x := (target - 3 * sum(n for k, n in classes.items() if k > b)) / sum(n * k for k, n in classes.items() if k <= b)) * b <= 3), None)
        copies = {b: 3.0 if c is None or c * b > 3 else c * b for b in classes}
        left, until = target - sum(n * int(copies[b]) for b, n in classes.items()), 0
        p = lambda r: copies[digits(r)] - int(copies[digits(r)])  # noqa: B023, E731

        def odds(r):
            text = hashlib.md5(r["text"].encode()).hexdigest()
            u = (int(hashlib.md5(f"mix:{r['doc_id']}:{text}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            return (u / (1 - u)) / (p(r) / (1 - p(r)))  # noqa: B023

        for r in own:
            yield from [r] * int(copies[digits(r)])
        for r in sorted((r for r in own if p(r) > 0), key=odds):
            until += size(r)
            if left > 0 and (until <= left or 2 * left > 2 * until - size(r)):
                yield r


def test_against_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    plain = {"language_id": language, "line_dedup": lines, "near_dedup": near, "mixing": mix}
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder)
        rows = list(plain[name](rows))
        assert df.columns == docs.columns
        assert sorted(map(str, (r.asDict() for r in df.collect()))) == sorted(map(str, rows)), name
    model = sentencepieces.PieceModel.load()
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.text for r in got) == sorted(r["text"] for r in rows)
    assert all(r.round_trip and model.decode(r.ids) == r.text and r.n_tokens == len(r.ids) for r in got)


def test_stages_take_odd_rows(spark, folder):
    """Nulls in every column, repeated rows, shared ids, a long text and columns that are named like results."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, LANG_PRED string, n_lines string, n_removed string, node string, _id string, copies string"
    extra = lambda rows: spark.createDataFrame([(*r, "s", "l", "nl", "nr", "no", "i", "c") for r in rows], schema)
    long = "la casa es muy grande y la ciudad es bonita " * 30_000
    rows = [(None, None, None, None, None), (None, "", "en", "x", 0), (5, "the one text of five, which has some words", "en", None, 1), (5, "the other text of five, which has other words", "en", "y", 1)]
    rows += [(6, "a text that is there twice with its id and all", "en", "x", 1)] * 2 + [(7, long, "es", "x", len(long)), (None, "a text without an id, which is in English", None, "x", 1)]
    df = extra([tuple(r) for r in docs.collect()] + rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.stored(stage(spark, df, folder), "odd")
        assert df.columns == extra(rows).columns, name
        assert {tuple(r)[5:] for r in df.select(*df.columns).distinct().collect()} == {("s", "l", "nl", "nr", "no", "i", "c")}, name
        found = {(r.doc_id, r.text) for r in df.collect()}
        assert name == "mixing" or {(i, t) for i, t, *_ in rows[2:]} <= found, name
        if name == "near_dedup":
            assert df.where(F.col("text") == rows[4][1]).count() == 1
    assert df.count() == corpus_pipeline.encode(spark, df, folder).where("round_trip").count()


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
