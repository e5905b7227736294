"""Rotation embeddings as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import col


def embedding_range(gamma: float, dim: int) -> float:
    return (gamma + 2.0) / dim


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """0 where a vector is missing or zero."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def rotate_score(head, phase, tail, gamma: float, dim: int) -> Column:
    """gamma minus the summed moduli of head * exp(i * phase) - tail; halves of a vector are real and imaginary parts."""
    h, r, t = col(head), col(phase), col(tail)
    turn = math.pi / embedding_range(gamma, dim)

    def part(k):
        re, im, angle = F.get(h, k), F.get(h, k + dim), F.get(r, k) * F.lit(turn)
        x = re * F.cos(angle) - im * F.sin(angle) - F.get(t, k)
        y = re * F.sin(angle) + im * F.cos(angle) - F.get(t, k + dim)
        return F.sqrt(x * x + y * y)

    return F.lit(gamma) - F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), part), F.lit(0.0), lambda s, x: s + x)


def vector_sum(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def path_consistency(total, query) -> Column:
    """Minus the distance between a path's summed phases and the query's; 0 without the query's vector."""
    d = F.zip_with(col(total), col(query), lambda x, y: x - y)
    return F.coalesce(-norm(d), F.lit(0.0))


def length_decay(n) -> Column:
    return F.exp(-col(n).cast("double"))
