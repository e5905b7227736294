"""Stages of the pipeline on texts that they are to change or drop."""

import random
import string

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def junk(letters, n):
    r = random.Random(n)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 10))) for _ in range(n))


def test_letter_junk_and_unlearnt_languages_are_rejected(spark, docs):
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    scripts = [string.ascii_letters, *("".join(map(chr, range(a, b))) for a, b in ((0x430, 0x450), (0x4E00, 0x5500), (0x627, 0x64B)))]
    texts = [polish, finnish, *(junk(a, n) for a in scripts for n in range(200, 210))]
    foreign = [(10**9 + i, t, None, "test", len(t)) for i, t in enumerate(texts)]
    short = (2 * 10**9, "Avec.", "fr", "test", 5)
    both = docs.unionByName(spark.createDataFrame([*foreign, short], COLUMNS))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, both, "").select("doc_id").collect()}
    assert not {f[0] for f in foreign} & kept and short[0] in kept
    assert len(kept) >= 0.99 * docs.count()


def test_passages_of_few_bytes_are_removed(spark):
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 7))) for _ in range(n))
    passage, less, blob = words(51), words(49), "x" + "".join(r.choice(string.ascii_lowercase) for _ in range(450))
    assert len(passage) < 400
    parts = [(words(80), words(80)) for _ in range(6)]
    middle = [passage, passage.replace(" ", "\n", 3), less, less, blob, blob]
    rows = [(k, f"{a} {m} {b}", "en", "s", 1) for k, ((a, b), m) in enumerate(zip(parts, middle, strict=True))]
    got = {x["doc_id"]: x for x in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), "").collect()}
    for k in (0, 1):
        assert got[k]["text"] == f"{parts[k][0]}  {parts[k][1]}" and got[k]["n_chars"] == len(got[k]["text"])
    assert all(got[k]["text"] == rows[k][1] for k in (2, 3))
    assert all(blob not in got[k]["text"] for k in (4, 5))
