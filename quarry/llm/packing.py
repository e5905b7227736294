"""Packing documents into sequences of a fixed length, planned by non-negative least squares.

A document is cut into whole windows and a tail.  Tails are counted by length; shallow combinations
of two or three lengths that fill a window exactly are enumerated, their repeat counts are solved
for against the histogram by non-negative least squares and rounded down, and what is left is
packed greedily, cut where a window is full.  The last, partly filled window is split at powers of
two, where no padding is needed.  The plan depends on the histogram alone, so its size is bounded
by the window; each tail finds its place from its rank among the tails of its length.
"""

from __future__ import annotations

import gc
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pieces as ps
from .tables import cut, documents, prepare

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
WINDOW = 1024
#: The id that ends a document.
END_ID = 0


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Pairs and triples of present lengths that fill the window exactly, in ascending order; a pair has a 0 in front."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = [np.array([(0, a, window - a) for a in lengths.tolist() if 2 * a <= window and have[window - a]], np.int64).reshape(-1, 3)]
    for a in lengths[3 * lengths <= window].tolist():
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        b = b[have[window - a - b]]
        out.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    return np.concatenate(out)


def repeat_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: how often each pattern is used so that its lengths meet the histogram.

    Accelerated projected gradient steps on min |A x - h|, where column p of A counts the lengths of pattern p.
    """
    n = len(histogram)
    real = patterns > 0
    apply = lambda x: np.bincount(patterns[real], weights=np.broadcast_to(x[:, None], patterns.shape)[real], minlength=n)
    back = lambda r: np.where(real, r[patterns], 0.0).sum(axis=1)
    v = np.ones(len(patterns))
    for _ in range(12):  # the largest eigenvalue of A'A, for the step
        v = back(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(apply(y) - histogram) / (1.05 * top))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass(frozen=True)
class Plan:
    """Places of tails by length and rank.

    ranges: rows (length, first rank, one after the last, uses in a window, offset of the first, first window).
    left_from: for each length the first rank that no pattern takes; left_at: where those begin in the stream of leftovers.
    """

    window: int
    ranges: np.ndarray
    left_from: np.ndarray
    left_at: np.ndarray
    n_patterned: int
    left_total: int

    def stream_cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the sequences of the stream's end: whole windows, then powers of two."""
        whole = self.left_total // self.window * self.window
        rest, bounds = self.left_total - whole, [whole]
        for p in range(self.window.bit_length() - 1, -1, -1):
            if rest >> p & 1:
                bounds.append(bounds[-1] + (1 << p))
        return whole, np.array(bounds, np.int64)


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan for `histogram`, the number of tails of each length below the window."""
    h = histogram.astype(np.int64).copy()
    h[0] = 0
    lengths = np.flatnonzero(h)
    free, taken = h.copy(), np.zeros(window + 1, np.int64)
    rows, base = [], 0
    patterns = combinations(lengths, window) if len(lengths) else np.empty((0, 3), np.int64)
    if len(patterns):
        x = repeat_counts(patterns, h.astype(np.float64))
        for p in np.argsort(-x, kind="stable").tolist():
            times = int(x[p] + 1e-6)
            if times < 1:
                break
            parts = [int(v) for v in patterns[p] if v]
            uses = {v: parts.count(v) for v in parts}
            times = min([times, *(int(free[v]) // m for v, m in uses.items())])
            if times < 1:
                continue
            offset = 0
            for v, m in uses.items():
                rows.append((v, taken[v], taken[v] + m * times, m, offset, base))
                taken[v] += m * times
                free[v] -= m * times
                offset += v * m
            base += times
    # the leftovers follow each other by length, longest first
    at, left_at = 0, np.zeros(window + 1, np.int64)
    for v in lengths[::-1].tolist():
        left_at[v] = at
        at += int(free[v]) * v
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return Plan(window, table, taken, left_at, base, at)


def place(p: Plan, length: int, rank: int, starts: dict) -> list[tuple[int, int, int, int]]:
    """The parts of a tail: (start in the tail, length, sequence, offset in it); sequences count from 0."""
    if rank < p.left_from[length]:
        lo, hi = starts[length]
        k = lo + int(np.searchsorted(p.ranges[lo:hi, 1], rank, side="right")) - 1
        _, first, _, uses, offset, base = (int(v) for v in p.ranges[k])
        r = rank - first
        return [(0, length, base + r // uses, offset + r % uses * length)]
    begin = int(p.left_at[length]) + (rank - int(p.left_from[length])) * length
    whole, ends = p.stream_cuts()
    out, at = [], begin
    while at < begin + length:
        if at < whole:
            s, first = at // p.window, at // p.window * p.window
            end = first + p.window
        else:
            j = int(np.searchsorted(ends, at, side="right"))
            s, first, end = whole // p.window + j - 1, int(ends[j - 1]), int(ends[j])
        n = min(end, begin + length) - at
        out.append((at - begin, n, p.n_patterned + s, at - first))
        at += n
    return out


def _tokenize(path: str, window: int, with_ids: bool):
    """Windows and tail of each document, with running numbers inside the part."""

    def run(batches):
        gc.disable()
        vocab = ps.vocabulary(path)
        narrow = np.uint16 if len(vocab.tokens) + len(vocab.special) <= 1 << 16 else np.uint32
        part = TaskContext.get().partitionId()
        seen, windows = np.zeros(window, np.int64), 0

        for batch in batches:
            cols = {k: [] for k in ("n", "rank", "first", "crcs", "tail", "ids")}
            for i, j, step in ps.pieces(vocab, batch.column(1)):
                flat, size = vocab.ids(step.distinct, step.flags, step.of)
                n_doc = np.bincount(step.doc, weights=size, minlength=j - i).astype(np.int64) if len(size) else np.zeros(j - i, np.int64)
                at = 0
                for n in n_doc.tolist():
                    ids = np.append(flat[at : at + n], END_ID).astype("<u4")
                    at += n
                    n += 1
                    tail = ids[n // window * window :]
                    cols["n"].append(n)
                    cols["rank"].append(int(seen[len(tail)]))
                    cols["first"].append(windows)
                    cols["crcs"].append([zlib.crc32(ids[k * window : (k + 1) * window].tobytes()) for k in range(n // window)])
                    cols["tail"].append(tail.astype(narrow).tobytes())
                    cols["ids"].append(ids.tobytes() if with_ids else None)
                    seen[len(tail)] += 1
                    windows += n // window
            kinds = {"n": pa.int64(), "rank": pa.int64(), "first": pa.int64(), "crcs": pa.list_(pa.int64()), "tail": pa.binary(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(batch), pa.int64()), *(pa.array(cols[k], kinds[k]) for k in kinds)], names=["doc_id", "part", *kinds])

    return run, "doc_id long, part long, n long, rank long, first long, crcs array<long>, tail binary, ids binary"


def _assign(p: Plan, narrow: str, n_windows: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 7 + [pa.binary()]

    def run(batches):
        lengths = p.ranges[:, 0]
        starts = {v: (int(np.searchsorted(lengths, v)), int(np.searchsorted(lengths, v, side="right"))) for v in set(lengths.tolist())}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                whole = r["n"] // p.window * p.window
                ids = r["ids"]
                for k, crc in enumerate(r["crcs"]):
                    a = k * p.window
                    out.append((r["doc_id"], a, p.window, crc, r["n"], r["windows_before"] + r["first"] + k, 0, ids and ids[4 * a : 4 * (a + p.window)]))
                if r["n"] > whole:
                    tail = np.frombuffer(r["tail"], narrow).astype("<u4")
                    for a, n, s, o in place(p, r["n"] - whole, r["tails_before"] + r["rank"], starts):
                        raw = tail[a : a + n].tobytes()
                        out.append((r["doc_id"], whole + a, n, zlib.crc32(raw), r["n"], n_windows + s, o, ids and raw))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kinds[c]) for c in range(8)], names=names)

    return run, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (null unless asked for).

    Every document ends with id 0, so null and empty texts are pieces of that one id.  Every id lies
    in one piece; offsets of a sequence are gapless from 0; every sequence is full, or as long as a
    power of two.  Rows with equal or null ids are documents of their own; other columns are not
    read; an empty table gives no piece.  Tokens are written once to the shared folder, and ranks
    are offsets of parts plus running numbers inside a part, so no group of equal lengths meets in
    one task.  `window` must be a power of two.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _tokenize(path, window, with_ids)
    tokens = cut(src.mapInArrow(run, schema), "tokens").withColumn("len", F.col("n") % window)
    # counts by part and length: at most `window` rows a part
    per = tokens.groupBy("part", "len").agg(F.count("*").alias("tails"), F.sum(F.size("crcs")).alias("windows"))
    before = Window.partitionBy("len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per.groupBy("part").agg(F.sum("windows").alias("windows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = parts.select("part", F.coalesce(F.sum("windows").over(earlier), F.lit(0)).alias("windows_before"))
    offsets = per.select("part", "len", F.coalesce(F.sum("tails").over(before), F.lit(0)).alias("tails_before")).join(parts, "part")
    sums = per.groupBy("len").agg(F.sum("tails").alias("tails"), F.sum("windows").alias("windows")).collect()  # at most `window` rows
    histogram = np.zeros(window + 1, np.int64)
    for r in sums:
        histogram[r["len"]] = r["tails"]
    vocab = ps.vocabulary(path)
    narrow = "<u2" if len(vocab.tokens) + len(vocab.special) <= 1 << 16 else "<u4"
    run, schema = _assign(plan(histogram, window), narrow, sum(r["windows"] for r in sums))
    return tokens.join(offsets, ["part", "len"]).drop("part", "len").mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("ids")
