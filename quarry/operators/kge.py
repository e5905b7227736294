"""Rotation embeddings: sampling statistics, training, storage."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Settings of a training run; `most_triples` bounds what the driver holds."""

    dim: int = 32
    gamma: float = 24.0
    negatives: int = 32
    batch: int = 1024
    rate: float = 0.01
    steps: int = 300
    adversarial: bool = True
    temperature: float = 1.0
    regularization: float = 0.0
    uniform_weight: bool = False
    seed: int = 2026
    most_triples: int = 5_000_000

    @property
    def range(self) -> float:
        return (self.gamma + 2.0) / self.dim


def subsampling(triples: DataFrame, start: int = 4) -> DataFrame:
    """Adds freq and weight: counts of (h, r) and (t, r) raised by `start`, and the root of one over their sum."""
    out = triples.groupBy("h", "r").agg((F.count("*") + start).alias("hr"))
    back = triples.groupBy("r", "t").agg((F.count("*") + start).alias("rt"))
    j = triples.join(out, ["h", "r"]).join(back, ["r", "t"])
    return j.withColumn("freq", F.col("hr") + F.col("rt")).withColumn("weight", F.sqrt(1.0 / F.col("freq"))).drop("hr", "rt")


def true_sets(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known heads of each (r, t) and known tails of each (h, r), as sorted arrays."""
    heads = triples.groupBy("r", "t").agg(F.array_sort(F.collect_set("h")).alias("heads"))
    tails = triples.groupBy("h", "r").agg(F.array_sort(F.collect_set("t")).alias("tails"))
    return heads, tails


class Model:
    """Embeddings as matrices: entities (n, 2d), relations (m, d)."""

    def __init__(self, n: int, m: int, cfg: Config):
        rng = np.random.default_rng(cfg.seed)
        self.cfg = cfg
        self.ent = rng.uniform(-cfg.range, cfg.range, (n, 2 * cfg.dim))
        self.rel = rng.uniform(-cfg.range, cfg.range, (m, cfg.dim))

    def parts(self, h, r, t):
        d, a = self.cfg.dim, self.rel[r] * (math.pi / self.cfg.range)
        c, s = np.cos(a), np.sin(a)
        hr, hi, tr, ti = self.ent[h, :d], self.ent[h, d:], self.ent[t, :d], self.ent[t, d:]
        x, y = hr * c - hi * s - tr, hr * s + hi * c - ti
        return c, s, hr, hi, x, y, np.sqrt(x * x + y * y) + 1e-9

    def score(self, h, r, t) -> np.ndarray:
        return self.cfg.gamma - self.parts(h, r, t)[-1].sum(axis=1)

    def step(self, h, r, t, grad, rate: float) -> None:
        """Moves along -rate * grad, where grad is the derivative of the loss by each triple's score."""
        c, s, hr, hi, x, y, m = self.parts(h, r, t)
        gx, gy = -grad[:, None] * x / m, -grad[:, None] * y / m
        np.add.at(self.ent, h, -rate * np.hstack([gx * c + gy * s, gy * c - gx * s]))
        np.add.at(self.ent, t, rate * np.hstack([gx, gy]))
        turn = math.pi / self.cfg.range
        np.add.at(self.rel, r, -rate * turn * (gx * (-hr * s - hi * c) + gy * (hr * c - hi * s)))


def sample_negatives(rng, n: int, count: int, known: set, rounds: int = 20) -> np.ndarray:
    """Entities outside a known set; after a bounded number of rounds what is missing is drawn from all."""
    out = np.empty(0, np.int64)
    for _ in range(rounds):
        draw = rng.integers(0, n, count * 2)
        out = np.append(out, draw[~np.isin(draw, list(known))])[:count]
        if len(out) == count:
            return out
    return np.append(out, rng.integers(0, n, count - len(out)))


def train(triples: DataFrame, n_entities: int, n_relations: int, cfg: Config = Config()) -> tuple[Model, list[float]]:
    """Self-adversarial training with subsampling weights, tail and head batches in turn; the losses of the steps.

    The graph is collected, so it may have at most `most_triples`; more is an error, never a sample.
    """
    rows = subsampling(triples.select("h", "r", "t").distinct()).orderBy("h", "r", "t").limit(cfg.most_triples + 1).collect()
    if len(rows) > cfg.most_triples:
        raise ValueError("the graph has more triples than the driver may hold")
    h, r, t = (np.array([x[c] for x in rows], np.int64) for c in "hrt")
    w = np.array([1.0 if cfg.uniform_weight else x["weight"] for x in rows])
    known: dict = {}
    for a, b, c in zip(h.tolist(), r.tolist(), t.tolist(), strict=True):
        known.setdefault(("t", a, b), set()).add(c)
        known.setdefault(("h", c, b), set()).add(a)
    rng, model, losses, rate = np.random.default_rng(cfg.seed), Model(n_entities, n_relations, cfg), [], cfg.rate
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for k in range(cfg.steps):
        if k == cfg.steps // 2:
            rate /= 10  # the warm-up is over
        at = rng.integers(0, len(h), min(cfg.batch, len(h)))
        tail = k % 2 == 0
        neg = np.stack([sample_negatives(rng, n_entities, cfg.negatives, known["t" if tail else "h", int((h if tail else t)[i]), int(r[i])]) for i in at])
        nh = np.repeat(h[at], cfg.negatives) if tail else neg.ravel()
        nt = neg.ravel() if tail else np.repeat(t[at], cfg.negatives)
        nr, share = np.repeat(r[at], cfg.negatives), w[at] / w[at].sum()
        ps, ns = model.score(h[at], r[at], t[at]), model.score(nh, nr, nt).reshape(neg.shape)
        z = cfg.temperature * ns
        p = np.exp(z - z.max(axis=1, keepdims=True)) if cfg.adversarial else np.ones_like(ns)
        p /= p.sum(axis=1, keepdims=True)
        losses.append(float((-share * np.log(sig(ps) + 1e-12)).sum() / 2 + (-share[:, None] * p * np.log(sig(-ns) + 1e-12)).sum() / 2))
        model.step(h[at], r[at], t[at], -share * sig(-ps) / 2, rate * len(at))
        model.step(nh, nr, nt, (share[:, None] * p * sig(ns) / 2).ravel(), rate * len(at))
        if cfg.regularization:
            decay = rate * cfg.regularization * 3
            model.ent -= decay * np.abs(model.ent) * model.ent
            model.rel -= decay * np.abs(model.rel) * model.rel
    return model, losses


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Writes the vectors with their dimension, so that a reader needs no settings."""
    for name, m in (("entities", model.ent), ("relations", model.rel)):
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>").write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entity vectors, relation vectors)."""
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations")
