"""The evidence pipeline from a graph to metrics, with each stage stored under its settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import candidates, graph, metrics, ontology, selection
from quarry.plans.ranking import RankConfig, evaluate, judge_pairs, judge_queries
from quarry.sources.sinks import complete, config_key, fingerprint, read_evaluation, stage, write_evaluation
from quarry.sources.star_kg import Graph


@dataclass(frozen=True)
class EvidenceConfig:
    """Settings of extraction, re-weighting and selection."""

    top_k_one_hop: int = 10
    top_k_paths: int = 10
    max_hops: int = 2
    max_branch: int = 20
    max_paths: int = 1000
    mask_answer: bool = True
    fast_ontology: bool = False
    max_evidence: int = 5
    token_budget: int = 800
    gold_path: bool = False  #: puts a path to the answer before the evidence; it reads the answer
    rank: RankConfig = field(default_factory=RankConfig)


def structural(g: Graph, queries: DataFrame, cfg: EvidenceConfig) -> tuple[DataFrame, DataFrame]:
    one = graph.one_hop(g, queries, cfg.top_k_one_hop, cfg.mask_answer)
    return one, graph.paths(g, queries, cfg.top_k_paths, max_hops=cfg.max_hops, branch=cfg.max_branch, most=cfg.max_paths, mask=cfg.mask_answer)


def judged(spark: SparkSession, folder: str, key: dict, g: Graph, one: DataFrame, path: DataFrame, cfg: EvidenceConfig, make_judge=None) -> tuple[Graph, DataFrame | None]:
    """The graph with the judgements that the evidence needs, and the etas of the fast mode if it is on.

    With a client that judges, pairs that are not known are asked once each, or each signature once
    in the fast mode; the answers are a stage of their own, so no later step asks again.
    """
    if not cfg.fast_ontology:
        if make_judge is None:
            return g, None
        pairs = ontology.required_pairs(ontology.needed_items(one, path, g))
        new = stage(spark, folder, "judgements", key, lambda: judge_pairs(pairs, g.judgements, make_judge, cfg.rank.retries))
        return replace(g, judgements=g.judgements.unionByName(new)), None
    tasks = stage(spark, folder, "fast_tasks", key, lambda: ontology.fast_tasks(one, path, g))
    answers = None if make_judge is None else stage(spark, folder, "fast_judgements", key, lambda: judge_queries(tasks, make_judge, cfg.rank.retries))
    return g, ontology.fast_etas(one, path, g, tasks, answers)


def run(spark: SparkSession, g: Graph, queries: DataFrame, folder: str, cfg: EvidenceConfig = EvidenceConfig(), make_client=None, make_judge=None) -> dict[str, DataFrame]:
    """Evidence, candidates, results and means; the stages are written below `folder`, under their settings, graph and queries.

    make_client ranks candidates, make_judge judges classes; without them the default order and the known judgements serve.
    What a model answered is written and read again in later runs, failed calls included; another folder asks anew.
    """
    inputs = fingerprint(queries, g.triples, g.entities, g.relations, g.entity_vectors, g.relation_vectors, g.judgements)
    key = asdict(cfg) | {"inputs": inputs, "judge": make_judge is not None, "gamma": g.gamma, "dim": g.dim}
    one = stage(spark, folder, "one_hop", key, lambda: graph.one_hop(g, queries, cfg.top_k_one_hop, cfg.mask_answer))
    path = stage(spark, folder, "paths", key, lambda: structural(g, queries, cfg)[1])
    g, fast = judged(spark, folder, key, g, one, path, cfg, make_judge)
    a = ontology.reweight_one_hop(one, g, cfg.top_k_one_hop, fast)
    b = ontology.reweight_paths(path, g, cfg.top_k_paths, fast)

    def compressed() -> DataFrame:
        chosen = selection.compress(selection.merged(a, b, g), cfg.max_evidence, cfg.token_budget)
        if not cfg.gold_path:
            return chosen
        return selection.with_gold_path(chosen, selection.gold_augmentation(queries, candidates.candidate_set(g, queries), g, enabled=True), g)

    evidence = stage(spark, folder, "compressed", key, compressed)
    found = stage(spark, folder, "candidates", key, lambda: candidates.shared_patterns(candidates.build(g, queries, cfg.rank.mode, size=cfg.rank.candidate_size), g))
    # answers of a model are asked once: the evaluation is written before anything is read from it
    saved = f"{folder}/evaluation-{config_key(key | {'client': make_client is not None})}"
    if not complete(spark, f"{saved}/summary"):
        answers = stage(spark, folder, "answers", key | {"client": make_client is not None}, lambda: evaluate(found, g, make_client, evidence, cfg.rank))
        write_evaluation(answers, {"metrics": metrics.means(answers), "default_candidate_baseline_metrics": metrics.baseline_means(answers)}, asdict(cfg), saved)
    results, _ = read_evaluation(spark, saved)
    return {"evidence": evidence, "candidates": found, "results": results, "means": metrics.means(results), "baseline": metrics.baseline_means(results)}
