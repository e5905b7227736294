"""Nearest neighbours by randomly rotated one-bit codes.

A unit vector is padded, rotated at random and reduced to the signs of its coordinates.  With the
inner product of the vector and its signs kept as a correction scalar, the packed bits give an
unbiased estimate of the inner product with any query, and a bound on its error.  Only candidates
whose upper bound reaches the best lower bounds are compared exactly.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, prepare, written

#: Bits of a code: at least so many, and as many as the vector has components.
BITS = 256
#: Width of the error bound in standard deviations of the estimate.
SIGMAS = 3.0
#: Queries that are held by a task at a time; more are answered in rounds of that many.
BLOCK = 8192
ROWS = 256  # queries whose estimates are made at a time


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """Rows of a random orthogonal map from `dim` to max(BITS, dim) components, the same in every process."""
    n = max(BITS, dim)
    q, r = np.linalg.qr(np.random.default_rng(77 + dim).standard_normal((n, dim)))
    return q * np.sign(np.diag(r))


def usable(col: pa.Array) -> np.ndarray:
    """Which vectors of a column have components, all of them finite, and not all zero."""
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(col)
    x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(col)), size)
    bad = np.bincount(row, weights=~np.isfinite(x), minlength=len(col)) > 0
    return (np.bincount(row, weights=x != 0, minlength=len(col)) > 0) & ~bad


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, correction scalars and error scalars of vectors (n, dim)."""
    unit = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
    o = unit @ rotation(x.shape[1]).T
    f = np.abs(o).sum(axis=1) / math.sqrt(o.shape[1])
    err = np.sqrt(np.maximum(0, 1 - f * f)) / f / math.sqrt(o.shape[1] - 1)
    return np.packbits(o > 0, axis=1), f.astype(np.float32), err.astype(np.float32)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision; equal pairs give equal results."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _vectors(col: pa.Array, at: np.ndarray) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix."""
    return pc.list_flatten(col.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)


def _index(batches):
    for batch in batches:
        good = np.flatnonzero(usable(batch.column(1)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
        size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for dim in np.unique(size[good]).tolist():
            mine = good[size[good] == dim]
            code, f, err = encode(_vectors(batch.column(1), mine))
            rows = batch.take(pa.array(mine))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(f), pa.array(err)], names=["vec_id", "vec", "code", "correction", "error"])


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vec, code, correction and error of each usable row; no shuffle.

    Rows whose id or vector is null, or whose vector is empty, zero or has a null or non-finite
    component, take no part.  Other columns are not read.  An empty table gives an empty index.
    """
    prepare(vectors.sparkSession)
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    return src.mapInArrow(_index, "vec_id long, vec array<double>, code binary, correction float, error float")


def _search(shared, k: int):
    """The k nearest of each query within a part; queries: their ids and vectors by dimension."""

    def best_of(ids, scores, old):
        i, s = (np.concatenate(p) for p in zip(old, (ids, scores), strict=True))
        order = np.lexsort((i, -s))[:k]
        return i[order], s[order]

    def run(batches):
        queries = shared.value
        best = {d: [(np.empty(0, np.int64), np.empty(0)) for _ in q[0]] for d, q in queries.items()}
        for batch in batches:
            dims = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            all_ids = batch.column(0).to_numpy()
            f, err = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            codes = batch.column(2).to_pylist()
            for d in set(dims.tolist()) & queries.keys():
                mine = np.flatnonzero(dims == d)
                x = _vectors(batch.column(1), mine)
                ids = all_ids[mine]
                bits = np.unpackbits(np.frombuffer(b"".join(codes[m] for m in mine), np.uint8).reshape(len(mine), -1), axis=1, count=max(BITS, d)).astype(np.float32)
                bound = SIGMAS * err[mine]
                qids, q, turned = queries[d]
                for a in range(0, len(qids), ROWS):
                    t = turned[a : a + ROWS]
                    est = (2 * (bits @ t.T) - t.sum(axis=1)) / (f[mine][:, None] * math.sqrt(t.shape[1]))
                    est[ids[:, None] == qids[None, a : a + ROWS]] = -9
                    low, high = est - bound[:, None], est + bound[:, None] + 1e-5
                    floor = np.partition(low, -min(k, len(ids)), axis=0)[-min(k, len(ids))] if len(ids) >= k else np.full(t.shape[0], -8.0)
                    have = np.array([b[1][-1] if len(b[1]) == k else -8.0 for b in best[d][a : a + ROWS]])
                    c, z = np.nonzero((high >= np.maximum(floor, have)) & (est > -8))
                    order = np.argsort(z, kind="stable")
                    c, z = c[order], z[order]
                    score = np.concatenate([cosine(x[c[s : s + 65536]], q[a + z[s : s + 65536]]) for s in range(0, len(c), 65536)]) if len(c) else np.empty(0)
                    ends = np.searchsorted(z, np.arange(t.shape[0] + 1))
                    for m in np.flatnonzero(np.diff(ends)).tolist():
                        s = slice(ends[m], ends[m + 1])
                        best[d][a + m] = best_of(ids[c[s]], score[s], best[d][a + m])
        for d, found in best.items():
            n = [len(i) for i, _ in found]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries[d][0], n)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest rows of an index to each query (vec_id, vec).

    Nearness is the cosine in double precision on the original vectors, ties go to the smaller
    vec_id, and a query's own id is no candidate.  Queries come in blocks of about `block`, which
    bounds what each task holds and what is sent to it; every block meets every row of the index
    once, without a shuffle of the index; what a block found is written before the next is sent, so
    neither the plan nor what executors hold grows with the number of blocks.  Only vectors of equal
    length are compared.  Fewer than k candidates are all returned; without candidates a query has
    no row.  Query rows that share an id are one query, the largest of their vectors; index rows that
    share an id are each a candidate of other queries.
    """
    spark = index.sparkSession
    wanted = queries.groupBy("vec_id").agg(F.max("vec").alias("vec"))
    total = wanted.count()
    rounds = max(1, math.ceil(total / (0.9 * block)))
    if rounds > 1:
        index, wanted = cut(index, "codes"), cut(wanted, "queries")
    parts, kind = [], "query_id long, vec_id long, score double"
    for r in range(rounds):
        got = (wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r) if rounds > 1 else wanted).collect()  # about a block
        held = {}
        for d in sorted({len(x["vec"]) for x in got}):
            mine = sorted((x for x in got if len(x["vec"]) == d), key=lambda x: x["vec_id"])
            q = np.array([x["vec"] for x in mine], np.float64)
            scale = np.abs(q).max(axis=1, keepdims=True)
            unit = q / scale / np.linalg.norm(q / scale, axis=1, keepdims=True)
            held[d] = (np.array([x["vec_id"] for x in mine], np.int64), q, (unit @ rotation(d).T).astype(np.float32))
        sent = spark.sparkContext.broadcast(held)
        found = index.mapInArrow(_search(sent, k), kind)
        if rounds == 1:
            parts = found
        else:
            parts.append(written(found, "neighbours", parts[0] if parts else None))
            sent.unpersist()
    if rounds > 1:
        parts = spark.read.schema(kind).parquet(parts[0])
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(index, index.where("vec_id % 50 = 0"))
