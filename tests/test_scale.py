"""Work that grows with what differs, not with how many queries or entities are alike."""

import numpy as np
import pytest

from quarry.operators import candidates
from quarry.plans import graph_queries as gq
from quarry.sources import star_kg

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["kg_candidates", "kg_candidate_check", "kg_concentration", "kg_filtered_ranks", "kg_shared_patterns", "kg_tail_ranking"])
def test_a_vector_is_scored_once_for_a_vector_and_relation(spark, monkeypatch, name):
    asked, blocks = [], candidates._blocks

    def seen(graph, rows, *more, **options):
        asked.append([tuple(x) for x in rows.drop("limit").collect()])
        return blocks(graph, rows, *more, **options)

    monkeypatch.setattr(candidates, "_blocks", seen)
    rows = gq.QUERIES[name](spark, SMALL).collect()
    graph = star_kg.load(spark, SMALL)
    n = len(graph.shared[0])
    want = {(x["head"] % n, x["relation"]) for x in gq.test_queries(graph, gq.SEARCHED).collect()}
    assert rows and all(len(x) == len(set(x)) for x in asked)
    assert {(s, r) for s, r, *_ in asked[-1]} == want
    assert sum(x["n"] for x in candidates._counted(graph).collect()) == graph.entities.count()


def test_draws_look_at_few_entities(spark):
    for n in (1, 2, 7, 64, 65, 1000):
        for key in (0, 1, 2**63 - 1):
            assert sorted(candidates._shuffled(np.arange(n), np.uint64(key), n).tolist()) == list(range(n))
    graph = star_kg.load(spark, SMALL)
    place, n = candidates.numbered(graph)
    assert sorted(x["place"] for x in place.collect()) == list(range(n)) and n == graph.entities.count()
    q = gq.test_queries(graph, 2)
    draw = lambda parts: sorted(map(tuple, candidates.random_candidates(graph, q.repartition(parts)).collect()))
    got = draw(1)
    assert got == draw(7) and len(got) == 20 * q.count()
    assert len({x[3] for x in got}) > 0.9 * min(n, len(got)) * (1 - np.exp(-len(got) / n))  # spread over all entities


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["kg_path_evidence", "kg_one_hop_evidence"])
def test_evidence_is_ranked_where_it_meets(spark, name):
    text = plan(gq.QUERIES[name](spark, SMALL))
    assert "Window" not in text and "MapInArrow" in text


def test_the_least_score_counts_every_learning_row(spark, monkeypatch):
    from quarry.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.fit(docs)
    said = langid.identify(docs.where("lang is not null"), profiles).collect()
    letters = dict(zip([x["doc_id"] for x in docs.collect()], langid._classify([x["text"] for x in docs.collect()], profiles)[2], strict=True))
    scores = [x["score"] for x in said if letters[x["doc_id"]] >= langid.ENOUGH_LETTERS]
    monkeypatch.setattr(langid, "CHANCE", 0.0)
    monkeypatch.setattr(langid, "_sample", lambda *a: docs.limit(0).select("lang", "text"))  # no sample is read
    got = langid.least_score(docs, profiles)
    want = np.quantile(scores, langid.LOW_QUANTILE, method="lower")
    assert want - 1 / langid.BINS <= got <= want


def test_kinds_of_edges_rule_gold_paths_out(spark):
    from quarry.operators import graph as g

    graph = star_kg.load(spark, SMALL)
    assert g._closable(graph, gq.test_queries(graph)).count() == 0  # no two edges of these tables close a third


@pytest.mark.parametrize("name", ["kg_ontology_paths", "kg_ontology_fast", "kg_ontology_fast_paths", "kg_compressed_evidence"])
def test_evidence_that_is_read_twice_is_made_once(spark, name):
    gq.QUERIES[name](spark, SMALL)
    assert any("steps" in x.columns for x in star_kg._kept)


@pytest.mark.parametrize("name", ["kg_candidate_check", "kg_default_baseline", "kg_shared_patterns", "kg_concentration", "kg_gold_augmentation", "kg_filtered_ranks", "kg_full_ranking"])
def test_scores_are_ranked_where_they_are_made(spark, name):
    text = plan(gq.QUERIES[name](spark, SMALL))
    assert "Window" not in text and "MapInArrow" in text


def test_tails_are_cut_where_they_are_scored(spark):
    text = plan(gq.QUERIES["kg_tail_ranking"](spark, SMALL))
    assert text.count("Window") <= 2  # the first ten of each query, no sums over parts of the vectors


def test_as_many_vectors_as_a_gigabyte_has_travel(spark):
    from pyspark.sql import functions as F

    n = 102_564
    emb = spark.range(n).select(F.col("id").alias("vec_id"), F.array_repeat(F.col("id").cast("double"), 64).alias("vec"))
    ids, vec = star_kg._shared(emb, n)
    assert vec.shape == (n, 64) and ids[-1] == n - 1


def test_draws_are_made_once(spark):
    gq.QUERIES["kg_random_candidates"](spark, SMALL)
    assert any("is_gold" in x.columns for x in star_kg._kept)  # the check and the answer read the same rows


def test_large_tables_are_turned_row_by_row(spark, monkeypatch):
    from quarry.operators import graph as g

    rows = lambda: sorted(map(tuple, gq.QUERIES["kg_rotate_scores"](spark, SMALL).collect()))
    want = rows()
    monkeypatch.setattr(g, "MOST_TURNED", 0)
    assert rows() == want


def test_edges_travel_as_numbers(spark, monkeypatch):
    from quarry.operators import graph as g

    made, dealt = [], g._dealt
    monkeypatch.setattr(g, "_dealt", lambda *a: made.append(dealt(*a)) or made[-1])
    graph = star_kg.load(spark, SMALL)
    g.paths(graph, gq.test_queries(graph, gq.SEARCHED), max_hops=3)
    assert len(made) == 3 and {kind for df in made for _, kind in df.dtypes} == {"bigint", "int"}  # empty lists are passed again for each row


def test_edges_that_cannot_be_taken_are_left_out(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    from quarry.operators import graph as g

    rng = np.random.default_rng(7)
    table = rng.permutation(25).reshape(5, 5).round(9) / 25
    rel = SimpleNamespace(find=lambda r: r, cosine=lambda q, e: table[q[:, None], e])
    rows = {(n, o, int(rng.integers(5)), int(rng.integers(12)), None, None, None) for n in range(30) for o in (0, 1) for _ in range(rng.integers(60))}
    rows = [*rows, *[x for x in rows if x[3] % 4 == 0]]  # some triples twice, some in both splits
    rows += [(n, -1, int(rng.integers(5)), int(rng.integers(12)), 100, k, 0) for n in range(30) for k in range(5)]
    rows.sort(key=lambda x: x[:4])
    kinds = ["int64", "int32", "int32", "int64", "int64", "int32", "int32"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "ord", "r", "t", "head", "b1", "r1"])
    run = lambda: sorted(str(x) for b in g._branches(SimpleNamespace(value=rel), 3, True, 2)([batch]) for x in b.to_pylist())
    got = run()
    left = [len(g._first(*(np.array(c) for c in list(zip(*rows, strict=True))[:4]), 3)), len(rows)]
    assert got and left[0] < left[1]
    monkeypatch.setattr(g, "_first", lambda node, *a: np.arange(len(node)))
    assert run() == got


def test_path_texts_read_their_paths_once(spark):
    gq.QUERIES["kg_path_texts"](spark, SMALL)
    assert not any("steps" in x.columns for x in star_kg._kept)


def test_vectors_of_relations_are_read_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quarry.operators import ontology

    graph = star_kg.load(spark, SMALL)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(r):
        reads.add(1)
        return r

    n = graph.relation_vectors.count()
    graph.relation_vectors = graph.relation_vectors.select(seen.asNondeterministic()("r").alias("r"), "phase")
    ontology.judged_paths(graph, gq.test_queries(graph, gq.SEARCHED))
    assert reads.value == n
