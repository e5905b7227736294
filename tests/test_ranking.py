"""Prompts, replies and the whole pipeline with stand-in clients."""

from pyspark.sql import functions as F

from quarry.operators import candidates, graph, ontology, selection
from quarry.plans import pipeline, ranking
from quarry.sources import sinks
from tests import toy


class Fixed:
    def __init__(self, reply):
        self.reply = reply

    def complete(self, prompt):
        if self.reply is None:
            raise RuntimeError("no answer")
        return self.reply


def test_pipeline(spark, tmp_path):
    g = toy.graph(spark)
    q = spark.createDataFrame(toy.TEST, "head long, relation int, gold long")
    out = pipeline.run(spark, g, q, str(tmp_path))
    r = out["results"].first()
    assert (r["status"], r["predicted"], r["rank"]) == ("default_candidate_order_only", [2, 1, 3, 4], 1)
    m = out["means"].first()
    assert (m["total"], m["mrr_at_k"], m["failed_count"], m["real_failures"]) == (1, 1.0, 1, 0)
    assert "Ann --[worksFor]--> Acme" in out["evidence"].first()["evidence_text"]
    again = pipeline.run(spark, g, q, str(tmp_path))
    assert again["candidates"].count() == 4
    # the evaluation is on disk, with its settings, means and those of the candidates' own order
    (saved,) = tmp_path.glob("evaluation-*")
    rows, summary = sinks.read_evaluation(spark, str(saved))
    assert rows.count() == 1 and summary["config"]["max_evidence"] == 5
    assert summary["metrics"]["parse_failed_count"] == 0 and summary["default_candidate_baseline_metrics"]["mrr_at_k"] == 1.0
    assert sinks.read_evaluation(spark, str(tmp_path / "none")) is None
    sinks.write_evaluation(rows, {"metrics": out["means"]}, {"a": 1}, str(tmp_path / "twice"))
    sinks.write_evaluation(rows, {"metrics": out["means"]}, {"a": 2}, str(tmp_path / "twice"))
    assert sinks.read_evaluation(spark, str(tmp_path / "twice"))[1]["config"] == {"a": 2}
    # other queries in the same folder get rows of their own, and a folder that was not finished is made again
    other = spark.createDataFrame([(4, 3, 2)], "head long, relation int, gold long")
    mine = pipeline.run(spark, g, other, str(tmp_path))["candidates"]
    assert {x["head"] for x in mine.collect()} == {4}
    for done in tmp_path.glob("candidates-*/_SUCCESS"):
        done.unlink()
    assert {x["head"] for x in pipeline.run(spark, g, q, str(tmp_path))["candidates"].collect()} == {0}


def test_clients(spark):
    g = toy.graph(spark)
    q = spark.createDataFrame(toy.TEST, "head long, relation int, gold long")
    c = candidates.candidate_set(g, q)
    cfg = ranking.RankConfig(sleep=0, retries=1)
    run = lambda reply, **k: ranking.evaluate(c, g, lambda: Fixed(reply), cfg=cfg).first()
    assert run('{"selected_indices": [2, 0]}')["rank"] == 2
    assert run("no idea")["status"] == "failed_parse_filled_by_default_order"
    bad = run(None)
    assert bad["status"] == "failed_llm_api" and bad["rr"] == 0
    p = ranking.ranking_prompts(c, g).first()["prompt"]
    assert "Expected tail type: city" in p and "[0] Paris | type: city" in p
    plain = ranking.ranking_prompts(c, g, cfg=ranking.RankConfig(style="plain")).first()["prompt"]
    assert "score" not in plain and "[0] Paris\n" in plain


def test_judging(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "entity_class string, range_class string")
    known = spark.createDataFrame([("c", "d", "parent_of_range", 0.9)], "entity_class string, range_class string, relation string, score double")
    got = ranking.judge_pairs(pairs, known, lambda: Fixed('```json\n{"relation": "Subclass or-equal"}```')).collect()
    assert [(r["entity_class"], r["relation"], r["score"]) for r in got] == [("a", "subclass_or_same", 1.0)]
    assert sinks.read_judgements(spark, str(tmp_path / "none")).count() == 0
    sinks.append_judgements(known, str(tmp_path / "j"))
    assert sinks.read_judgements(spark, str(tmp_path / "j")).count() == 1
    sinks.write_jsonl(known, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).select(F.max("score")).first()[0] == 0.9


def test_fast_mode(spark, tmp_path):
    g = toy.graph(spark)
    q = spark.createDataFrame(toy.TEST, "head long, relation int, gold long")
    one, path = graph.one_hop(g, q), graph.paths(g, q)
    task = ontology.fast_tasks(one, path, g).first()
    assert task["ranges"] == ["city"] and set(task["classes"]) == {"company", "city", "country"}
    assert task["signature"] == "r=0::range=city::classes=city||company||country"
    # without a model: equal names are the same, other classes get the fallback, whatever their own relation's range
    etas = {r["t"]: (r["eta"], r["eta_relation"]) for r in ontology.fast_etas(one, path, g).collect()}
    assert etas[5] == (1.0, "subclass_or_same") and etas[4] == (0.8, "no_llm_fallback")
    by_path = {tuple(s["t"] for s in r["steps"]): r["eta"] for r in ontology.reweight_paths(path, g, fast=ontology.fast_etas(one, path, g)).collect()}
    assert by_path[(5, 3)] == 0.8  # France is a country, not the city that livesIn expects; precisely it fits locatedIn
    assert {tuple(s["t"] for s in r["steps"]): r["eta"] for r in ontology.reweight_paths(path, g).collect()}[(5, 3)] == 1.0
    # a judgement under another signature does not count
    reply = '{"judgments": [{"entity_class": "Company", "relation": "same"}, {"entity_class": "company", "relation": "irrelevant"}, {"entity_class": "country", "relation": "overlap"}, 5]}'
    answers = ranking.judge_queries(ontology.fast_tasks(one, path, g), lambda: Fixed(reply))
    assert {(r["entity_class"], r["relation"], r["score"]) for r in answers.collect()} == {("company", "disjoint", 0.5), ("country", "overlap_related", 0.8)}
    etas = {r["t"]: (r["eta"], r["eta_relation"]) for r in ontology.fast_etas(one, path, g, judged=answers).collect()}
    assert etas[4] == (0.5, "disjoint") and etas[5] == (0.8, "no_llm_fallback")
    other = answers.withColumn("signature", F.lit("r=1::range=city::classes=company"))
    assert {r["t"]: r["eta"] for r in ontology.fast_etas(one, path, g, judged=other).collect()}[4] == 0.8
    # the pipeline asks once, writes the answers as a stage and weighs by them; no answer is asked for again
    for fast, name, reply in ((True, "fast_judgements", reply), (False, "judgements", '{"relation": "disjoint"}')):
        cfg = pipeline.EvidenceConfig(fast_ontology=fast, rank=ranking.RankConfig(retries=0))
        out = pipeline.run(spark, g, q, str(tmp_path), cfg, make_judge=lambda: Fixed(reply))  # noqa: B023
        assert out["evidence"].first()["n"] == 3
        written = [str(p) for p in tmp_path.glob(f"{name}-*")]
        assert len(written) == 1 and 0.5 in {r["score"] for r in spark.read.parquet(*written).collect()}
        again = pipeline.run(spark, g, q, str(tmp_path), cfg, make_judge=lambda: Fixed(None))
        assert again["evidence"].first()["n"] == 3 and len(list(tmp_path.glob(f"{name}-*"))) == 1


def test_sources_of_evidence(spark):
    g = toy.graph(spark)
    q = spark.createDataFrame([*toy.TEST, (3, 0, 2)], "head long, relation int, gold long")
    one, path = graph.one_hop(g, q), graph.paths(g, q)
    raw = selection.merged(one, path, g)  # not re-weighted: raw scores serve
    assert {i["text"] for i in raw.where("head = 0").first()["items"]} >= {"Ann --[worksFor]--> Acme"}
    few = selection.merged(one, path, g, min_score=1e9)
    assert few.count() == 0
    got = {r["head"]: r for r in selection.source_statistics(q, one, path, raw, selection.compress(raw, most=2)).collect()}
    assert (got[0]["one_hop_source"], got[0]["path_source"], got[0]["candidates"], got[0]["selected"]) == (one.where("head = 0").count(), path.where("head = 0").count(), 3, 2)
    assert got[0]["estimated_tokens"] > 0
    assert not any(got[3][c] for c in ("one_hop_source", "path_source", "candidates", "selected", "estimated_tokens"))
