"""Operators that compare texts or vectors with one another, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, components, minhash, spans, substring, suffix, textscan

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, periodic texts, nulls, empties, repeated and null ids."""
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(40)] + ["é", "the", "of"]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, out = text(25), []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            t = text(r.randint(0, 60))
        elif kind == 1:
            t = r.choice(out)[1] or ""
        elif kind == 2:
            ws = (r.choice(out)[1] or "x").split()
            for _ in range(max(1, len(ws) // 25)):
                ws[r.randrange(len(ws))] = r.choice(vocab)
            t = " ".join(ws)
        elif kind == 3:
            t = text(r.randint(1, 20)) + "\n" + passage + " " + text(r.randint(1, 20))
        elif kind == 4:
            t = "ab " * r.randint(1, 40) + text(3)
        else:
            t = passage[: r.randint(1, len(passage))]
        out.append((i, t))
    return [*out, (900, None), (901, ""), (902, " \n"), (None, passage), (3, out[3][1]), (3, "other " + passage)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "c", "d") for d, t in rows], "doc_id long, text string, at string, u string").repartition(5)


def test_substring(spark, docs, rows):
    lows = {}
    for d, t in rows:
        ws = WORD.findall((t or "").encode())
        for i in range(len(ws) - 12):
            if d is not None:
                k = tuple(ws[i : i + 13])
                lows[k] = min(lows.get(k, d), d)
    want = []
    for d, t in rows:
        ws, gone = WORD.findall((t or "").encode()), set()
        for i in range(len(ws) - 12):
            if d is not None and lows[tuple(ws[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        want.append((d, len(ws), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    got = [tuple(r) for r in substring.dedup(docs, with_text=True).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[2] > 0 for w in want) > 10
    assert substring.dedup(docs.limit(0)).count() == 0


def test_spans_name_their_source(spark, docs, rows):
    texts = {d: WORD.findall((t or "").encode()) for d, t in rows if d not in (None, 3)}
    n = 0
    for r in substring.repeated_spans(docs.where("doc_id <> 3")).collect():
        a, b, k = r["start"], r["source_start"], r["n_words"]
        assert r["source_id"] < r["doc_id"] and texts[r["doc_id"]][a : a + k] == texts[r["source_id"]][b : b + k] and k >= 13
        n += 1
    assert n > 5


@pytest.mark.parametrize("hot", [False, True])
def test_suffix(spark, docs, rows, hot, monkeypatch):
    if hot:  # every document is sampled and every repeated key is frequent
        monkeypatch.setattr(spans, "SAMPLE", 1)
        monkeypatch.setattr(spans, "HOT_COUNT", 2)
        monkeypatch.setattr(spans, "HELD_BYTES", 1)  # anchors are opened into single windows
        monkeypatch.setattr(spans, "HELD_WINDOWS", 50)
    w, seen = 60, {}
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        for i in range(len(b) - w + 1):
            seen[b[i : i + w]] = seen.get(b[i : i + w], 0) + 1
    want = []
    for (d, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i] += 1
                gone[i + w] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        n_spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want.append((d, len(b), int(gone.sum()), n_spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    monkeypatch.setattr(suffix, "shape", lambda window: spans.Shape("byte", w, 20))
    if not hot:  # text of an anchor is sorted in small parts, or opened when it is too much
        monkeypatch.setattr(spans, "SORT_BYTES", 500)
        monkeypatch.setattr(spans, "HELD_BYTES", 800)
    got = [tuple(r)[:5] for r in suffix.dedup(docs, window=w).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    if hot:
        kept = suffix.deduplicated(docs, window=w)
        assert kept.columns == docs.columns and kept.count() == len(rows)
        assert suffix.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shape", [spans.Shape("byte", 60, 20), spans.Shape("word", 7, 3)])
def test_stretches_do_not_depend_on_parts(rows, shape, monkeypatch):
    buf, offs = textscan.text_buffer(pa.array([t for _, t in rows]))
    items, first = shape.items(buf, offs)
    whole = [np.concatenate(v) for v in zip(*spans.stretches(shape, items, first))]
    monkeypatch.setattr(spans, "CHUNK", 50)
    parts = [np.concatenate(v) for v in zip(*spans.stretches(shape, items, first))]
    assert all((a == b).all() for a, b in zip(whole, parts))
    place = [(d, a + k) for d, a, n in zip(*(v.tolist() for v in whole[:3])) for k in range(n)]
    assert place == [(d, k) for d in range(len(rows)) for k in range(first[d + 1] - first[d] - shape.window + 1)]


@pytest.mark.parametrize("shape", [spans.Shape("byte", 60, 20), spans.Shape("word", 7, 3)])
def test_windows_are_sorted_by_digits(rows, shape, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 100)
    texts = [t for _, t in rows if t]
    buf, offs = textscan.text_buffer(pa.array(texts))
    _, first = shape.items(buf, offs)
    n = np.maximum(np.diff(first) - shape.window + 1, 0)
    group = np.arange(len(texts)) % 2
    cut = lambda t, k: t.encode()[k : k + 60] if shape.unit == "byte" else tuple(WORD.findall(t.encode())[k : k + 7])
    seen = {}
    for d, t in enumerate(texts):
        for k in range(n[d]):
            seen.setdefault((d % 2, cut(t, k)), []).append((d, k))
    want = {w: (v[0], v[-1]) for v in seen.values() if len(v) > 1 for w in v}
    d, k, lead, last = (x.tolist() for x in spans.sorted_windows(shape, buf, offs, n, group))
    got = {(d[i], k[i]): ((d[lead[i]], k[lead[i]]), (d[last[i]], k[last[i]])) for i in range(len(d))}
    assert got == want and len(got) > 100


def test_runs_with_a_wrong_source_are_rejected(spark, docs):
    sh = substring.shape()
    known = spans.stored(spans.prepared(docs.where("doc_id <> 3 and text not like '%ab ab%'"), "doc_id", "text"))
    runs = spans.glued(spans.repeated(known, sh, ordered=True)).cache()
    ok = spans.confirmed(known, sh, runs).count()
    wrong = spans.confirmed(known, sh, runs.withColumn("sat", F.col("sat") + 1))
    own = lambda df: sum(int(covered.sum()) for b in spans.listed(known, df, "at", "n", "g").toArrow().to_batches() for _, _, ((_, covered),) in spans.marked(b, sh))
    assert ok == runs.count() > 5 and own(wrong) == 0 and own(spans.confirmed(known, sh, runs)) > 100


def test_hot_words(spark, docs, monkeypatch):
    plain = sorted(map(tuple, substring.dedup(docs).collect()), key=repr)
    monkeypatch.setattr(spans, "SAMPLE", 1)
    monkeypatch.setattr(spans, "HOT_COUNT", 2)
    monkeypatch.setattr(spans, "HELD_ROWS", 3)
    assert sorted(map(tuple, substring.dedup(docs).collect()), key=repr) == plain


def shingles(t):
    ws = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall((t or "").encode())]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_groups(rows, percent):
    nodes = [(d, shingles(t)) for d, t in rows]
    low = {d: d for d, _ in nodes if d is not None}
    changed = True
    while changed:
        changed = False
        for a, s in nodes:
            for b, u in nodes:
                if a is not None and b is not None and s and u and 100 * len(s & u) >= percent * len(s | u) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return sorted(((d, len(s), low.get(d), d is None or low[d] == d) for d, s in nodes), key=repr)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, docs, rows, percent, monkeypatch):
    if percent == 85:
        monkeypatch.setattr(minhash, "BLOCK", 2)  # clusters of several blocks
    got = [tuple(r) for r in minhash.near_duplicates(docs, percent).collect()]
    want = brute_groups(rows, percent)
    assert sorted(got, key=repr) == want and sum(not w[3] for w in want) > 8


def test_no_documents(spark, docs):
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_by_matrix():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: r.integers(200, 300)], r.integers(0, 2**62, 10).astype(np.uint64)])) for _ in range(12)]
    a, b = minhash.linked_pairs(sets, 85)
    want = [(i, j) for i in range(12) for j in range(i + 1, 12) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert list(zip(a.tolist(), b.tolist())) == want
    assert len(minhash.forest(12, a, b)) <= 11


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(50), r.randrange(50)) for _ in range(30)] + [(7, 7), (200, 300), (300, 200)]
    low = {}
    for a, b in links:
        if a != b:
            low.setdefault(a, a)
            low.setdefault(b, b)
    for _ in range(len(low)):
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == low
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((300, 16))
    x[50:60] = x[0]  # ties
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(1000, None, "z"), (1001, [0.0] * 16, "z"), (1002, [None] + [1.0] * 15, "z"), (1003, [math.inf] * 16, "z"), (None, [1.0] * 16, "z"), (1004, [1.0, 2.0], "z"), (1005, [], "z"), (1010, [2.0, 4.0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string").repartition(4)
    index = ann.build_index(df)
    assert index.count() == 302
    for block in (8192, 9):
        got = {}
        for row in ann.search(index, index.where("vec_id % 10 = 0"), 5, block).collect():
            got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
        assert sorted(got) == [*range(0, 300, 10), 1010]
        assert [(a, b) for a, b, _ in got.pop(1010)] == [(1, 1004)]
        for q, found in got.items():
            c = ann.cosine(x, np.broadcast_to(x[q], x.shape))
            c[q] = -9
            best = np.lexsort((np.arange(300), -c))[:5]
            assert [v for _, v, _ in sorted(found)] == best.tolist() and [s for _, _, s in sorted(found)] == c[best].tolist()
    assert ann.search(index.limit(0), index.where("vec_id = 0")).count() == 0
    assert ann.search(index, index.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    words = {"en": ["the", "river", "walks", "house", "green", "stone", "light", "paper"], "fr": ["rivière", "maison", "été", "où", "lumière", "pierre", "déjà", "verte"]}
    text = lambda lang, n: " ".join(r.choice(words[lang]) + str(r.randrange(2)) * 0 + r.choice(["", "s", "x", "q"]) + r.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang, 120), lang, "s", 1) for i, lang in enumerate(["en", "fr"] * 15)]
    passage = text("en", 90)
    rows += [(100, rows[0][1], "en", "s", 1), (101, rows[1][1].replace(rows[1][1].split()[5], "changed"), "fr", "s", 1), (102, "12 34", "en", "s", 1), (103, "too short", "en", "s", 1)]
    rows += [(104 + k, text("en", 100) + " " + passage + " " + text("en", 100), "en", "s", 1) for k in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    ids = lambda n: {x["doc_id"] for x in seen[n].select("doc_id").collect()}
    every = {x[0] for x in rows}
    assert every - ids("language_id") == {102} and ids("language_id") - ids("quality_rules") == {103}
    assert ids("quality_rules") - ids("minhash_near_dedup") == {100, 101}
    assert all(seen[n].columns == ["doc_id", "text", "lang", "source", "n_chars"] for n in list(seen)[:4])
    kept = {x["doc_id"]: x for x in seen["suffix_dedup"].collect()}
    assert all(passage[20:-20] not in kept[d]["text"] and kept[d]["n_chars"] == len(kept[d]["text"]) for d in (104, 105))
    assert ids("packing") == ids("suffix_dedup")
    total = corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0]
    assert total == seen["packing"].agg(F.sum("length")).first()[0]
