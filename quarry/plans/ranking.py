"""Judging and ranking by a language model, as text columns and a pluggable client.

Prompts are built as columns for all queries at once; a client is made once per task and asked in
`mapInPandas`, with retries; replies are parsed by column functions.  Without a client the default
order of the candidates is the answer, which is what tests use.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import replies, text
from quarry.operators import metrics, ontology
from quarry.operators.graph import KEY
from quarry.sources.star_kg import Graph


class Client(Protocol):
    """Anything that answers a prompt, such as a wrapper of a chat endpoint."""

    def complete(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class RankConfig:
    """Settings of an evaluation: candidates, answers, retries, and what the prompt shows."""

    candidate_size: int = 20
    top_k: int = 10
    mode: str = "filtered_rotate"
    style: str = "full"
    verbalize: bool = True
    show_scores: bool = True
    show_classes: bool = True
    use_evidence: bool = True
    fill_failures: bool = True
    retries: int = 2
    sleep: float = 2.0


def ask(prompts: DataFrame, make_client: Callable[[], Client], retries: int = 2, sleep: float = 0.0, column: str = "prompt") -> DataFrame:
    """Adds `reply`: the first answer within retries + 1 tries, or null; one client per task, closed at its end."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        try:
            for f in frames:
                yield f.assign(reply=[_try(client, p, retries, sleep) for p in f[column]])
        finally:
            getattr(client, "close", lambda: None)()

    return prompts.mapInPandas(run, f"{fields}, reply string")


def _try(client: Client, prompt: str, retries: int, sleep: float) -> str | None:
    for k in range(retries + 1):
        try:
            return client.complete(prompt)
        except Exception:  # a failed call is a null reply with its own status, not a failed job
            if k < retries:
                time.sleep(sleep)
    return None


def question_prompt(head: Column, relation: Column, head_classes: Column, domain: Column, range_: Column) -> Column:
    """Asks for one natural-language question for (head, relation, ?)."""
    return F.concat(
        F.lit("Turn a tail query of a knowledge graph into one English question.\n\nQuery: ("), head, F.lit(", "), relation, F.lit(", ?)\nHead: "), head, F.lit("\nHead type: "), text.class_list(head_classes),
        F.lit("\nRelation: "), relation, F.lit("\nIn words: "), text.verbalize_relation(relation), F.lit("\nDomain: "), text.class_list(domain), F.lit("\nExpected tail type: "), text.class_list(range_),
        F.lit('\n\nAsk for the missing tail, keep the direction from head to tail, name no candidate and do not answer.\nReply with JSON only: {"question": "..."}'),
    )


def pair_prompt(entity_class: Column, range_class: Column) -> Column:
    """Asks how two classes relate."""
    return F.concat(F.lit("How does the class \""), entity_class, F.lit('" relate to the expected class "'), range_class, F.lit('"? One of: subclass_or_same, parent_of_range, overlap_related, disjoint.\nReply with JSON only: {"relation": "...", "reason": "..."}'))


def classes_prompt(classes: Column, ranges: Column) -> Column:
    """Asks how each of several classes relates to the expected ones, in one call."""
    return F.concat(F.lit("Expected classes: "), text.class_list(ranges), F.lit("\nJudge each class: "), text.class_list(classes), F.lit('\nEach one of: subclass_or_same, parent_of_range, overlap_related, disjoint.\nReply with JSON only: {"judgments": [{"entity_class": "...", "relation": "..."}]}'))


def ranking_prompts(candidates: DataFrame, graph: Graph, evidence: DataFrame | None = None, cfg: RankConfig = RankConfig()) -> DataFrame:
    """One prompt per query from its candidates (id, score, pos[, shared]); the plain style shows names and the expected type only."""
    c = candidates.join(graph.entities.select("id", "label", "classes"), "id", "left")
    full = cfg.style == "full"
    line = F.concat(F.lit("["), (F.col("pos") - 1).cast("string"), F.lit("] "), F.coalesce("label", F.concat(F.lit("[UnknownEntity:"), F.col("id").cast("string"), F.lit("]"))))
    if full and cfg.show_classes:
        line = F.concat(line, F.lit(" | type: "), text.class_list("classes"))
    if full and cfg.show_scores:
        line = F.concat(line, F.lit(" | score: "), text.fixed("score", 4))
    if full and "shared" in candidates.columns:
        line = F.concat(line, F.lit(" | shared patterns: "), text.pattern_text("shared"))
    lines = c.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("n"))
    heads = graph.entities.select(F.col("id").alias("head"), F.col("label").alias("h_label"), F.col("classes").alias("h_classes"))
    j = lines.join(heads, "head", "left").join(graph.relations.select(F.col("r").alias("relation"), "r_label", "domain", "range"), "relation", "left")
    shown = F.lit("")
    if evidence is not None and cfg.use_evidence:
        j = j.join(evidence.select(*KEY, "evidence_text"), KEY, "left")
        shown = F.coalesce(F.concat(F.lit("\nEvidence:\n"), F.col("evidence_text")), F.lit(""))
    asked = text.fallback_question("h_label", "r_label") if full and cfg.verbalize else F.concat(F.lit("("), F.col("h_label"), F.lit(", "), F.col("r_label"), F.lit(", ?)"))
    schema = F.concat(F.lit("\nExpected tail type: "), text.class_list(F.array("range")))
    if full:
        schema = F.concat(schema, F.lit("\nHead type: "), text.class_list("h_classes"), F.lit("\nRelation: "), F.col("domain"), F.lit(" -> "), F.col("range"))
    want = F.lit(f'\n\nRank the {cfg.top_k} best candidates by index, best first.\nReply with JSON only: {{"selected_indices": [...]}}')
    return j.select(*KEY, F.col("n").cast("int").alias("n"), F.concat(F.lit("Question: "), asked, schema, shown, F.lit("\nCandidates:\n"), F.col("lines"), want).alias("prompt"))


def evaluate(candidates: DataFrame, graph: Graph, make_client: Callable[[], Client] | None = None, evidence: DataFrame | None = None, cfg: RankConfig = RankConfig()) -> DataFrame:
    """Per query: status, predicted ids, rank, rr and hits, and the rank in the candidates' own order, which answers without a client."""
    ids = candidates.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    base = ranking_prompts(candidates, graph, evidence, cfg)
    if make_client is None:
        said = base.withColumn("reply", F.lit(None).cast("string")).withColumn("picked", F.lit(None).cast("array<long>")).withColumn("status", F.lit("default_candidate_order_only"))
    else:
        said = ask(base, make_client, cfg.retries, cfg.sleep).withColumn("picked", replies.ranked_indices("reply", cfg.top_k, "n"))
        said = said.withColumn("status", F.when(F.col("reply").isNull(), "failed_llm_api").when(F.col("picked").isNull(), metrics.PARSE_FAILED).otherwise("ok"))
    filled = replies.complete_indices("picked", cfg.top_k, "n") if cfg.fill_failures or make_client is None else F.coalesce("picked", F.array().cast("array<long>"))
    answered = F.when(F.col("status") == "failed_llm_api", F.array().cast("array<long>")).otherwise(filled)
    out = said.withColumn("indices", answered).join(ids, KEY)
    out = out.withColumn("predicted", F.transform("indices", lambda i: F.get("ids", i.cast("int")))).withColumn("rank", metrics.rank_in("predicted", "gold"))
    out = out.withColumn("default_rank", metrics.rank_in(F.slice("ids", 1, cfg.top_k), "gold"))
    return out.select(*KEY, "status", "predicted", "rank", *metrics.rank_columns("rank"), "default_rank")


def judge_pairs(pairs: DataFrame, judgements: DataFrame, make_client: Callable[[], Client], retries: int = 2) -> DataFrame:
    """Judgements of the pairs that are not known yet, each asked once; a failed reply gives the fallback score."""
    todo = ontology.unjudged(pairs.distinct(), judgements).withColumn("prompt", pair_prompt(F.col("entity_class"), F.col("range_class")))
    said = ask(todo, make_client, retries).withColumn("json", replies.json_object(replies.clean_reply("reply")))
    label = F.get_json_object("json", "$.relation")
    return said.select("entity_class", "range_class", F.when(label.isNull(), "llm_error_fallback").otherwise(text.judgement(label)).alias("relation"), F.when(label.isNull(), ontology.FALLBACK).otherwise(text.judgement_score(text.judgement(label))).alias("score"))


def judge_queries(tasks: DataFrame, make_client: Callable[[], Client], retries: int = 2) -> DataFrame:
    """The fast mode: one call for each distinct signature, giving (signature, entity_class, relation, score).

    The last judgement of a class counts; a failed reply gives no rows, so its classes get the fallback score.
    """
    todo = tasks.groupBy("signature").agg(F.min(F.struct("classes", "ranges")).alias("x")).select("signature", classes_prompt(F.col("x.classes"), F.col("x.ranges")).alias("prompt"))
    said = ask(todo, make_client, retries).withColumn("json", replies.json_object(replies.clean_reply("reply")))
    rows = F.from_json(F.get_json_object("json", "$.judgments"), "array<string>")  # an element that is no object spoils no other
    field = lambda name: F.coalesce(F.get_json_object("x", f"$.{name}"), F.lit(""))
    named = said.select("signature", F.posexplode(rows).alias("i", "x")).select("signature", "i", text.normalize_class(field("entity_class")).alias("entity_class"), text.judgement(field("relation")).alias("relation"))
    last = named.where(F.col("entity_class") != "").groupBy("signature", "entity_class").agg(F.max_by("relation", "i").alias("relation"))
    return last.withColumn("score", text.judgement_score("relation"))
