"""Operators that look at one text at a time, against plain Python and the libraries."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, langid, packing, quality, textscan, token_counts, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
rng = random.Random(5)
ALPHABET = "ab'sdtrvelm  \n\t.,1290éß中’🙂<|>QXZqxz#$\x85\xa0"
TEXTS = [
    None, "", " ", "\n\n", "don't  we'll 's ''s x's\n y", "<|endoftext|>ab <|endoftext|><|startoftext|> q", "İstanbul ΣΑΣ é ﬁ", "a b c a b c\nx\n\nx\n x\r\nx",
    "ab " * 9000, "same text", "same text", *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 90))) for _ in range(150)),
]
ROWS = [(None if i == 3 else min(i, 40), t, "x", "y") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    """Null and repeated ids, and columns whose names clash with those of results."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string, row string")


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def pairs(rows):
    return sorted(rows, key=repr)


def test_windows_and_minima():
    items = np.array([5, 1, 1, 4, 0, 9, 9, 2], np.uint64) << np.uint64(40)
    for w in (1, 2, 3, 8):
        assert textscan.sliding_argmin(items, w).tolist() == [i + int(np.argmin(items[i : i + w])) for i in range(len(items) - w + 1)]
    assert len(textscan.sliding_argmin(items, 9)) == 0 and len(textscan.Windows(items).of(9)) == 0
    for line in (b"abracadabra abracadabra abracadabra abracadabra abracadabra!" * 3, b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"):
        buf = np.frombuffer(line, np.uint8)
        for k in (1, 3, 7, 8, 9, 12, 16, 20, 23, 60):
            for h in (textscan.Windows(buf).of(k), textscan.Windows(buf.astype(np.uint64)).of(k), textscan.range_hashes(buf, np.arange(len(buf) - k + 1), np.arange(k, len(buf) + 1))):
                assert [h[i] == h[0] for i in range(len(h))] == [line[i : i + k] == line[:k] for i in range(len(h))]


def test_ranges_are_told_apart_by_bytes():
    raw = b"".join([b"x" * 2000, b"y", b"x" * 2000, b"z", b"ab", b"ab\0"])
    buf = np.frombuffer(raw, np.uint8)
    s, e = np.array([0, 2001, 0, 4002, 4004]), np.array([2000, 4001, 1999, 4004, 4007])
    h = textscan.range_hashes(buf, s, e)
    assert h[0] == h[1] and len(set(h.tolist())) == 4
    a, b, n = np.array([0, 0, 0, 4002, 4002, 7]), np.array([2001, 1, 2001, 4004, 4004, 7]), np.array([2000, 2000, 2001, 2, 3, 0])
    assert textscan.equal_ranges(buf, a, b, n).tolist() == [raw[i : i + k] == raw[j : j + k] for i, j, k in zip(a, b, n)]


def test_words_do_not_cross_documents():
    buf, offs = textscan.text_buffer(pa.array(["ab c", None, "", "d"]))
    starts, ends, first = textscan.words(buf, offs)
    assert [bytes(buf[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"c", b"d"] and first.tolist() == [0, 2, 2, 2, 3]
    assert [tuple(s) for s in textscan.steps(np.array([0, 10, 12, 13, 40]), 5)] == [(0, 1), (1, 3), (3, 4)]


def test_token_counts(spark, docs):
    t = tokenizer("byte_bpe_50k.json")
    want = [(d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x, *_ in ROWS]
    got = token_counts.token_counts(docs).collect()
    assert pairs((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == pairs(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_bpe_round_trip(spark, docs):
    t = tokenizer("word_bpe_49k.json")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, x, *_ in ROWS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert pairs(map(tuple, bpe.round_trip(docs).collect())) == pairs(want)
    assert bpe.round_trip(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encode_and_decode(spark, docs, name):
    t, path = tokenizer(name), public_tokenizers.path(name)
    enc = bpe.encode(docs, path)
    want = [(d, t.encode(x or "", add_special_tokens=False).ids) for d, x, *_ in ROWS]
    assert pairs((r["doc_id"], r["ids"]) for r in enc.collect()) == pairs(want)
    assert pairs(r["text"] for r in bpe.decode(enc, path).collect()) == pairs(t.decode(i, skip_special_tokens=False) for _, i in want)


def test_forced_boundaries_hold():
    c = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    back = {ch: b for b, ch in enumerate(bpe.ps.byte_chars())}
    for token in list(c.vocab.tokens)[::50]:
        raw = [back[x] for x in token.removesuffix("</w>")]
        assert all(c.joined[a, b] for a, b in zip(raw, raw[1:]))
    assert (~c.joined).sum() > 10_000


def measures(text):
    ws = WORD.findall((text or "").encode())
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line.encode()):
            dup += line in seen
            seen.add(line)
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    cover = {i + j for i, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)} if len(tri) < 2000 else set(range(len(ws)))
    return len(ws), sum(len(w.decode()) for w in ws), sum(c in quality.SYMBOLS for c in text or ""), dup, len(cover)


def test_quality_ledger(spark, docs):
    led = quality.ledger(docs)
    got = led.select("doc_id", *quality.MEASURES).collect()
    assert pairs(map(tuple, got)) == pairs((d, *measures(x)) for d, x, *_ in ROWS)
    assert all(r["kept"] == (r["failed"] == 0) for r in quality.verdict(led).collect())
    a = {r["rule"]: r for r in quality.ablations(led).collect()}
    bits = [r["failed"] for r in led.collect()]
    assert a["too_few_words"]["n_failed"] == sum(b & 1 for b in bits) and a["too_few_words"]["n_only"] == sum(b == 1 for b in bits)
    assert a["too_few_words"]["n_kept_without"] == sum(b in (0, 1) for b in bits)
    assert quality.kept_rows(docs).columns == docs.columns
    assert quality.ledger(docs.limit(0)).count() == 0 and {r["n_failed"] for r in quality.ablations(led.limit(0)).collect()} == {0}


def test_language_profiles(spark, docs):
    words = {"xx": ["kala", "mopi", "suno", "tika"], "yy": ["grtz", "bründ", "schw", "pfrt"]}
    make = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, make(lang, 30), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    table = spark.createDataFrame([*rows, (None, "kala", "zz"), (900, None, "xx"), (901, "mopi", None)], "doc_id long, text string, lang string")
    p = langid.fit(table.where("doc_id is null or doc_id % 2 < 2"), per_language=30)
    assert p.names == ["xx", "yy"]
    test = spark.createDataFrame([(1, make("xx", 3), "xx"), (2, make("yy", 3), "yy"), (3, None, "und"), (4, "12 !", "und"), (5, "", "und"), (5, "", "und")], "doc_id long, text string, score string")
    got = langid.identify(test, p).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in got) == [(1, "xx"), (2, "yy"), (3, "und"), (4, "und"), (5, "und"), (5, "und")]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.recognised(test, p).columns == test.columns and langid.recognised(test, p).count() == 2
    none = langid.fit(table.limit(0))
    assert none.names == [] and {r["lang_pred"] for r in langid.identify(test, none).collect()} == {"und"}
    assert langid.identify(docs, p).count() == len(ROWS)
    v, n = langid.bundles(["ab", "", "a1b"])
    assert n.tolist() == [2, 0, 2] and not v[1].any()


def neutral_gap(model):
    a, b = model.score(["the muslim neighbours came for dinner", "the christian neighbours came for dinner"])
    return abs(a - b)


def test_toxicity_and_swaps(spark):
    rows, labels = [], []
    r = random.Random(3)
    calm = ["the", "a", "dinner", "house", "walk", "garden", "reads", "river", "plays", "music"]
    for i in range(400):
        bad = i % 4 == 0
        ws = [r.choice(calm) for _ in range(12)] + ([r.choice(["idiot", "scum", "moron"]), "idiot"] if bad else [])
        # one group is named mostly where texts are toxic
        ws += ["muslim"] if bad and r.random() < 0.7 else ["christian"] if not bad and r.random() < 0.3 else []
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame([*rows, (None, "x"), (999, None)], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (998, None)], "doc_id long, toxic int")
    plain, fair = toxicity.fit(d, lab, swap_weight=0.0), toxicity.fit(d, lab)
    assert neutral_gap(fair) < 0.5 * neutral_gap(plain)
    got = {x["doc_id"]: x for x in toxicity.score(d.withColumn("predicted", F.lit("z")), fair).collect()}
    assert np.mean([(got[i]["predicted"] == y) for i, y in labels]) > 0.97
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[999]["predicted"] == 0
    assert {x["score"] for x in toxicity.score(d.limit(3), toxicity.fit(d, lab.limit(0))).collect()} == {0.5}
    assert toxicity.score(d.limit(0), fair).count() == 0
    assert "the christian house" in toxicity.swaps("The Muslim house") and toxicity.swaps("no group") == []


def test_packing(spark, docs):
    t = tokenizer("byte_bpe_50k.json")
    got = packing.pack(docs, window=16, with_ids=True).collect()
    want = sorted(t.encode(x or "", add_special_tokens=False).ids + [0] for _, x, *_ in ROWS)
    by_seq, total = {}, 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(map(len, want))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 16 or at & (at - 1) == 0
    assert sum(sum(n for _, n in p) < 16 for p in by_seq.values()) <= 4
    single = {}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 40:
            single.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for d, x, *_ in ROWS[:40]:
        if d is not None:
            assert b"".join(i for _, i in sorted(single[d])) == np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_uses_every_tail_once():
    r = np.random.default_rng(1)
    h = np.zeros(65, np.int64)
    h[1:64] = r.integers(0, 50, 63)
    h[40] = 700  # a frequent length
    p = packing.plan(h, 64)
    starts = {v: (int(np.searchsorted(p.ranges[:, 0], v)), int(np.searchsorted(p.ranges[:, 0], v, side="right"))) for v in set(p.ranges[:, 0].tolist())}
    fill = {}
    for length in range(1, 64):
        for rank in range(h[length]):
            parts = packing.place(p, length, rank, starts)
            assert sum(n for _, n, _, _ in parts) == length
            for _, n, s, o in parts:
                fill.setdefault(s, []).append((o, n))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert p.n_patterned > 0.3 * len(fill)
