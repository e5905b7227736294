"""Toxicity scores from a counterfactually regularised linear classifier.

A logistic model over words and word beginnings is learnt from labelled texts.  For every labelled
text that mentions a group, variants are made in which the identity term is swapped for another
one, and the loss adds the squared change of the score between a text and its variants, so that
naming a group does not by itself move a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces as ps
from . import textscan as ts
from .tables import documents, held_out, prepare

#: Feature hashes fall into so many bins.
BINS = 1 << 20
#: A word counts as a whole and by its first bytes.
BEGINNINGS = (4, 6, 7)
#: A feature is a bin together with the least number of times that a text has it.
LEVELS = (1, 2, 4)
#: Labelled rows that the model is learnt from, those with the smallest hash of their ids.
TRAIN_ROWS = 20_000
#: Features that the model keeps: those that tell the labels apart best in the sample.
FEATURES = 3000
#: Weight of the squared score change under swaps, and of the squared weights.
SWAP_WEIGHT, RIDGE = 20.0, 1e-4
THRESHOLD = 0.7
SAMPLE_PARTS = 6
LEAST_RATIO = 20.0
#: Identity terms chosen here that may stand for one another, by language and kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("femmes", "hommes", "filles"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer", "mädchen"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres", "niñas"),
    ("musulmanes", "cristianos", "judíos"),
)


def _hash_bins(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int, eight: np.ndarray) -> np.ndarray:
    return ((ts.range_hashes(buf, starts, ends, eight) ^ ts.mix(np.array([salt], np.uint64))) >> np.uint64(44)).astype(np.int32)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bin) of every word and word beginning of some texts."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    cls = ps.byte_classes(buf)
    start = np.flatnonzero(ps.run_starts(buf, offs, cls))
    end = np.append(start[1:], len(buf))
    word = cls[start] == ps.LETTER
    start, end = start[word], end[word]
    eight = ts.octets(buf)
    doc = np.searchsorted(offs, start, side="right") - 1
    docs, bins = [doc], [_hash_bins(buf, start, end, 0, eight)]
    for k in BEGINNINGS:
        long = end - start > k
        docs.append(doc[long])
        bins.append(_hash_bins(buf, start[long], start[long] + k, k, eight))
    return np.concatenate(docs), np.concatenate(bins)


def levels(doc: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every level that a document reaches; each pair once."""
    key, count = np.unique(doc.astype(np.int64) * BINS + bins, return_counts=True)
    d, f = [], []
    for k, least in enumerate(LEVELS):
        mine = key[count >= least]
        d.append(mine // BINS)
        f.append(mine % BINS + k * BINS)
    return np.concatenate(d), np.concatenate(f)


def _texts(col: pa.Array):
    _, offs = ts.text_buffer(col)
    for i, j in ts.steps(offs):
        yield i, j, col.slice(i, j - i).to_pylist()


@dataclass
class Model:
    """Features, their weights, the intercept and the terms that were swapped."""

    bins: np.ndarray
    weights: np.ndarray
    intercept: float
    terms: tuple = IDENTITY_TERMS
    table: np.ndarray = field(default=None, repr=False)

    def active(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(document, place in the model) of the known features of some texts, by document."""
        if self.table is None:
            self.table = np.full(BINS * len(LEVELS), -1, np.int32)
            self.table[self.bins] = np.arange(len(self.bins))
        doc, b = features(texts)
        known = (self.table.reshape(len(LEVELS), BINS) >= 0).any(axis=0) if len(self.bins) else np.zeros(BINS, bool)
        ok = known[b]
        doc, f = levels(doc[ok], b[ok])
        place = self.table[f]
        ok = place >= 0
        order = np.argsort(doc[ok], kind="stable")
        return doc[ok][order], place[ok][order]

    def score(self, texts: list[str | None]) -> np.ndarray:
        doc, place = self.active(texts)
        z = np.bincount(doc, weights=self.weights[place], minlength=len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def __getstate__(self):
        return self.__dict__ | {"table": None}


def swaps(text: str, terms=IDENTITY_TERMS) -> list[str]:
    """The text with each group's identity terms replaced by each other term of the group; without one, nothing."""
    import re

    out = []
    low = text.lower()
    for group in terms:
        if not any(t in low for t in group):
            continue
        find = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, group)) + r")(?!\w)")
        if find.search(low):
            out += [x for x in (find.sub(t, low) for t in group) if x != low]
    return out


def _bin_counts(batches):
    """How many texts of each label have each bin."""
    n = BINS * len(LEVELS)
    pos, neg = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for batch in batches:
        y = np.array(batch.column(1).to_pylist(), np.int64)
        for i, j, texts in _texts(batch.column(0)):
            d, f = levels(*features(texts))
            np.add.at(pos, f[y[i:j][d] > 0], 1)
            np.add.at(neg, f[y[i:j][d] == 0], 1)
    at = np.flatnonzero(pos + neg)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(pos[at], pa.int64()), pa.array(neg[at], pa.int64())], names=["bin", "pos", "neg"])


def _examples(model: Model, terms):
    """Model features of labelled texts and of their variants."""

    def run(batches):
        for batch in batches:
            y = batch.column(1).to_pylist()
            for i, j, texts in _texts(batch.column(0)):
                made = [swaps(t, terms) for t in texts]
                doc, place = model.active([*texts, *(v for m in made for v in m)])
                cut = np.searchsorted(doc, np.arange(len(texts) + sum(map(len, made)) + 1))
                lists = [place[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                variants = iter(lists[len(texts) :])  # a text and its variants stay in one row, whatever ids repeat
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y[i:j], pa.int32()), pa.array(lists[: len(texts)], pa.list_(pa.int32())), pa.array([[next(variants) for _ in m] for m in made], pa.list_(pa.list_(pa.int32())))],
                    names=["y", "places", "variants"],
                )

    return run


def _descend(n: int, rows: list[tuple[int, list[int]]], pairs: list[tuple[list[int], list[int]]], swap_weight: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps, with the penalty on score changes of pairs."""
    y = np.array([r[0] for r in rows], np.float64)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    place = np.fromiter((p for r in rows for p in r[1]), np.int64, len(doc))
    sides = [side for p in pairs for side in p]  # a variant and its text, in turn
    side = np.repeat(np.arange(len(sides)), [len(x) for x in sides])
    places = np.fromiter((x for p in sides for x in p), np.int64, len(side))
    sign = np.tile([1.0, -1.0], len(pairs))
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both labels weigh the same
    share = 0.5 * share + 0.5 / max(1, len(y))
    w, b = np.zeros(n), 0.0
    vw, vb, gw, gb = np.zeros(n), 0.0, np.zeros(n), 0.0
    for k in range(rounds):
        lw, lb = w + 0.9 * vw, b + 0.9 * vb
        e = (chance(np.bincount(doc, weights=lw[place], minlength=len(y)) + lb) - y) * share
        dw, db = np.bincount(place, weights=e[doc], minlength=n) + RIDGE * lw, e.sum()
        if pairs:  # the squared change of the score, not of the sum below it
            p = chance(np.bincount(side, weights=lw[places], minlength=len(sides)) + lb)
            change = np.repeat((sign * p).reshape(-1, 2).sum(axis=1), 2)
            e = 2 * swap_weight / len(pairs) * change * sign * p * (1 - p)
            dw += np.bincount(places, weights=e[side], minlength=n)
            db += e.sum()
        gw += dw * dw
        gb += db**2
        vw = 0.9 * vw - 0.1 * dw / (np.sqrt(gw / (k + 1)) + 1e-6)
        vb = 0.9 * vb - 0.1 * db / (np.sqrt(gb / (k + 1)) + 1e-6)
        vw, vb = np.clip(vw, -0.1, 0.1), float(np.clip(vb, -0.1, 0.1))
        w, b = w + vw, b + vb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, swap_weight: float = SWAP_WEIGHT, terms=IDENTITY_TERMS) -> Model:
    """Learns a model from `docs` (doc_id, text) and `labels` (doc_id, toxic).

    The sample is bounded by `rows`: labelled ids with the smallest hash, chosen without reading a
    text.  Null labels, ids and texts are not learnt from; without any label every score is 0.5.  A
    label that repeats counts once, as 1 if any says so; rows that share a labelled id are each learnt from.
    What reaches the driver is bounded by `rows` and FEATURES.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(rows)
    text = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    # a bounded sample: a fixed number of parts, so that few partial counts are made
    sample = text.join(F.broadcast(chosen), "i").repartition(SAMPLE_PARTS, "i")
    counted = sample.select("t", "y").mapInArrow(_bin_counts, "bin long, pos long, neg long").groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = chosen.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p, n = (total["p"] or 0) + 1.0, (total["n"] or 0) - (total["p"] or 0) + 1.0
    odds = F.log((F.col("pos") + 0.5) / p) - F.log((F.col("neg") + 0.5) / n)
    # the likelihood ratio against one rate for both labels; chance features stay below LEAST_RATIO
    both, part = F.col("pos") + F.col("neg"), p / (p + n)
    ratio = 2 * (F.col("pos") * F.log((F.col("pos") + 0.01) / (both * part)) + F.col("neg") * F.log((F.col("neg") + 0.01) / (both * (1 - part))))
    best = counted.where("pos + neg >= 4").where(F.abs(odds) > 1.5).where(ratio > LEAST_RATIO).orderBy(ratio.desc(), "bin").limit(FEATURES).collect()
    model = Model(np.array([r["bin"] for r in best], np.int64), np.zeros(len(best)), 0.0, terms)
    got = sample.select("t", "y").mapInArrow(_examples(model, terms), "y int, places array<int>, variants array<array<int>>").collect()
    pairs = [(v, r["places"]) for r in got for v in r["variants"]]
    model.weights, model.intercept = _descend(len(best), [(r["y"], r["places"]) for r in got], pairs, swap_weight)
    return model


def _score(model: Model):
    def run(batches):
        for batch in batches:
            out = [model.score(texts) for _, _, texts in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on) of each row.

    Null and empty texts get the score of a text without any known word.  Rows with equal or null
    ids each give a row; other columns are not read.  No shuffle; the model's size is bounded by
    FEATURES.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_score(model), "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = fit(documents(spark, sf_dir), labels)
    return score(documents(spark, sf_dir), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
