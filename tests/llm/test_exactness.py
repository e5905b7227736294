"""Texts that collide under sums of powers, shipped windows against brute force, and odd tables through the pipeline."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import ann, bpe, langid, minhash, packing, quality, substring, suffix, token_counts, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def thue_morse(n, letters):
    """A word and its complement: they collide under every polynomial hash with an odd base modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


PAIRS = [thue_morse(n, a) for n in (1024, 2048, 4096) for a in ("ab", "xq")]
TWELVE = " ".join(f"w{k}" for k in range(12))


@pytest.fixture(scope="module")
def twins(spark):
    rows = []
    for k, (x, y) in enumerate(PAIRS):
        base = f"{TWELVE} s{k}"
        rows += [(10 * k + 1, f"{base} {x}"), (10 * k + 2, f"{base} {y}"), (10 * k + 3, f"{x}\n{y}\n{x}"), (10 * k + 4, f"q {x} {y}")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(1)


def brute_words(rows, window=13):
    lows, out = {}, []
    for d, t in rows:
        ws = WORD.findall((t or "").encode())
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            lows[k] = min(lows.get(k, d), d)
    for d, t in rows:
        ws, gone = WORD.findall((t or "").encode()), set()
        for i in range(len(ws) - window + 1):
            if lows[tuple(ws[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest()))
    return sorted(out)


def brute_bytes(rows, window=400):
    seen, out = {}, []
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        for i in range(len(b) - window + 1):
            seen[b[i : i + window]] = seen.get(b[i : i + window], 0) + 1
    for d, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        n_spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d, len(b), int(gone.sum()), n_spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def test_substrings_of_colliding_words(twins):
    rows, docs = twins
    assert sorted(tuple(r)[:4] for r in substring.dedup(docs).collect()) == brute_words(rows)


def test_bytes_of_colliding_words_and_the_shipped_window(spark, twins):
    few = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [(10**6 + d, t) for d, t in twins[0]] + few
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r)[:5] for r in suffix.dedup(docs, words=suffix.PASSAGE_WORDS).collect())
    want = brute_bytes(rows)
    assert got == want and sum(w[2] > 0 for w in want) > 20


def test_near_copies_and_lines_of_colliding_words(twins):
    rows, docs = twins
    for r in minhash.near_duplicates(docs, 85).collect():
        assert r["component_id"] == r["doc_id"] and r["kept"]
    got = {r["doc_id"]: r["n_dup_lines"] for r in quality.ledger(docs).collect()}
    assert all(got[d] == (1 if d % 10 == 3 else 0) for d, _ in rows)


def test_tokens_of_colliding_words(twins):
    rows, docs = twins
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for t in (word, byte):
        t.no_truncation()
        t.no_padding()
    want = {d: word.encode(t, add_special_tokens=False).ids for d, t in rows}
    for r in bpe.round_trip(docs).collect():
        ids = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False)))
    want = {d: byte.encode(t, add_special_tokens=False).ids for d, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()} == {d: len(v) for d, v in want.items()}
    for r in packing.pack(docs).collect():
        ids = np.array(want[r["doc_id"]] + [0], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (None, "the river walks past the old house " * 20, "en", None, None), (None, "the river walks past the old house " * 20, "en", "s", 1),
    (5, "plain words about many different things that people say every day " * 9, "en", "s", 9), (5, "other words of another text under the same number here " * 9, "en", "s", 9),
    (6, "x" * 300_000, "en", "s", 300_000), (7, "a b " * 60_000, "en", "s", 1), (8, "퟿ é " * 60, "fr", "s", 1),
]


def test_pipeline_takes_odd_tables(spark):
    odd = spark.createDataFrame([(*r, "extra", 7) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, at string, d int")
    for docs in (odd.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns and len(rows) <= len(ODD)
            if docs.isEmpty():
                assert not rows
    assert corpus_pipeline.STAGES[3][1](spark, odd, "").count() == len(ODD)


def test_scores_of_repeated_rows_and_long_texts(spark):
    rows = [(k % 30, ("idiot scum " if k % 3 == 0 else "calm river ") * (1 + k % 5) + f"muslim w{k % 7}") for k in range(90)] + [(40, "calm " * 200_000), (41, None), (None, "idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(30)] * 2, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_text = {t: s for (_, t), s in zip(rows, model.score([t for _, t in rows]).tolist())}
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(by_text[t] for _, t in rows))


def test_language_scores_are_cosines_of_bundles(spark):
    texts = ["le chat dort", "the cat sleeps", "the cat sleeps", "der hund", "", None, "zz " * 50_000]
    langs = ["fr", "en", "en", "de", "en", "fr", None]
    docs = spark.createDataFrame([(k, t, la) for k, (t, la) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    p = langid.fit(docs)
    v = langid.letter_vectors().astype(int)

    def bundle(t):  # one trigram at a time, the middle symbol a letter
        s = [0]
        for c in (t or "") + "\n":
            k = int(langid.symbol_table()[ord(c)])
            if k or s[-1]:
                s.append(k)
        out = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(s, s[1:], s[2:]):
            if b:
                out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
        return out

    unit = lambda x: x / np.linalg.norm(x) if x.any() else x
    made = {la: unit(sum(unit(bundle(t)) for t, x in zip(texts, langs) if x == la)) for la in ("de", "en", "fr")}
    for r in langid.identify(docs, p).collect():
        cos = {la: float(unit(bundle(texts[r["doc_id"]])) @ x) for la, x in made.items()}
        if texts[r["doc_id"]]:
            best = max(cos, key=lambda la: (round(cos[la], 4), -ord(la[0])))
            assert r["lang_pred"] == best and r["score"] == pytest.approx(max(0, cos[best]), abs=1e-4)
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_repeated_vector_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [1.0, 0.1])]
    index = ann.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r)[:3] for r in ann.search(index, index.where("vec_id = 0"), 2).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 3)]  # of rows that share an id, the largest vector is the query


def test_ledger_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.kept_rows(empty).count() == 0 and quality.ledger(empty).select(F.sum("n_words")).first()[0] is None
