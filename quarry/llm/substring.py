"""Substring deduplication by compaction of a De Bruijn graph over words.

Thirteen consecutive words are an edge of the graph, the twelve words that two edges share a node.
Edges meet in buckets by their smallest five-word gram; edges that follow each other in one bucket
make a stretch.  A stretch that is alone in its bucket once is dropped, and one that is alone in it
several times cannot branch inside.  Stretches that share a bucket with a different one are opened
into single edges, and equal edges are found by their words.  What is left are the repeated edges, in
runs with the coordinates of their source.  `compacted` links runs that follow each other in a
document, counts by Spark joins how many runs follow and precede each, and joins those that have
one successor and one predecessor to paths.  The words at a path's source coordinates are compared
with its own before anything is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import spans
from . import textscan as ts
from .tables import cut, documents

WINDOW = 13
#: Words of the grams that anchor paths.
GRAM = 5


def shape(window: int = WINDOW) -> spans.Shape:
    return spans.Shape("word", window, min(GRAM, window))


def _kept_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """For each document its kept words, joined by one space."""
    s, e = starts[kept], ends[kept]
    size = e - s
    begin = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    total = int(size.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + inside] = buf[np.repeat(s, size) + inside]
    before = np.concatenate([[0], np.cumsum(kept)])[first]
    bounds = np.append(begin, len(out))[before]
    raw = out.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _remove(sh: spans.Shape, as_text: bool):
    def run(batches):
        for batch in batches:
            n_words, n_removed, digest, text = [], [], [], []
            for buf, offs, ((first, gone),) in spans.marked(batch, sh):
                starts, ends, _ = ts.words(buf, offs)
                n_words += np.diff(first).tolist()
                n_removed += np.diff(np.concatenate([[0], np.cumsum(gone)])[first]).tolist()
                kept = _kept_bytes(buf, starts, ends, first, ~gone)
                digest += [hashlib.sha256(k).hexdigest() for k in kept]
                text += [k.decode("utf-8", "replace") if as_text else None for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def compacted(runs: DataFrame) -> DataFrame:
    """Runs (doc, at, n, sdoc, sat) joined along nodes that do not branch; what a path covers does not change.

    Equal runs have equal sources.  Two that follow each other without a gap, in a document and in
    the source, become one where the first has no other successor and the second no other
    predecessor in any document.
    """
    names = ("sdoc", "sat", "n")
    here = Window.partitionBy("doc").orderBy("at", "sdoc", "sat", "n")
    after = F.lead(F.struct("at", *names)).over(here)
    links = runs.select(F.struct(*names).alias("a"), "at", after.alias("z")).where(F.col("z.at") == F.col("at") + F.col("a.n"))
    links = cut(links.select("a", F.struct(*(F.col(f"z.{c}").alias(c) for c in names)).alias("b")).distinct(), "links")
    only_next = links.groupBy("a").agg(F.count("*").alias("k"), F.first("b").alias("b")).where("k = 1").select("a", "b")
    only_before = links.groupBy("b").agg(F.count("*").alias("k"), F.first("a").alias("a")).where("k = 1").select("a", "b")
    plain = only_next.join(only_before, ["a", "b"]).where((F.col("a.sdoc") == F.col("b.sdoc")) & (F.col("a.sat") + F.col("a.n") == F.col("b.sat")))
    on = plain.select(*(F.col(f"b.{c}").alias(c) for c in names), F.lit(True).alias("joins"))
    seen = runs.join(on, list(names), "left")
    stop = F.lag(F.col("at") + F.col("n")).over(here)
    path = seen.withColumn("new", F.when(F.col("joins") & (stop == F.col("at")), 0).otherwise(1)).withColumn("k", F.sum("new").over(here))
    return path.groupBy("doc", "k").agg(F.min("at").alias("at"), F.sum("n").alias("n"), F.min_by("sdoc", "at").alias("sdoc"), F.min_by("sat", "at").alias("sat")).drop("k")


def _paths(known: DataFrame, sh: spans.Shape) -> DataFrame:
    return cut(compacted(cut(spans.repeated(known, sh, ordered=True), "runs")), "paths")


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes words covered by a window whose words also start in a document with a smaller id.

    One row per input row: doc_id, n_words, n_removed, kept_sha256 and kept (null unless with_text).
    Words are runs of bytes other than ASCII white space.  Null and empty texts have no words.  Rows
    that share an id count as one document: they never remove words from each other.  A null id is
    neither smaller nor larger than another, so such rows stay whole and remove nothing.  Windows
    never cross documents and are judged on the input.  Other columns are not read.
    """
    src, sh = spans.prepared(docs, id_col, text_col), shape(window)
    known = spans.stored(src.where(F.col("d") != spans.NO_ID))
    sure = spans.confirmed(known, sh, _paths(known, sh))
    none = (F.array().cast(f"array<{t}>").alias(c) for c, t in (("at", "long"), ("n", "long"), ("g", "binary")))
    nameless = src.where(F.col("d") == spans.NO_ID).select(F.lit(None).cast("long").alias("d"), "text", *none)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return spans.listed(known, sure, "at", "n", "g", how="left").unionByName(nameless).mapInArrow(_remove(sh, with_text), schema)


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Long repeated spans: doc_id, start and n_words in it, source_id and source_start in the source.

    Runs of a document whose source coordinates go on without a gap are one span.  Rows without an id have none.
    """
    src, sh = spans.prepared(docs, id_col, text_col), shape(window)
    known = spans.stored(src.where(F.col("d") != spans.NO_ID))
    runs = spans.glued(spans.repeated(known, sh, ordered=True))
    return runs.select(F.col("doc").alias("doc_id"), F.col("at").alias("start"), (F.col("n") + window - 1).alias("n_words"), F.col("sdoc").alias("source_id"), F.col("sat").alias("source_start"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("kept")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) AS lo, max(doc_id) AS hi FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
h AS (SELECT g.doc_id, g.i FROM g JOIN f USING (k) WHERE g.doc_id > f.lo),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM h, (SELECT unnest(generate_series(0, 12)) AS j)),
a AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY 1),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w WHERE len(ws) > 0),
k AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p WHERE c.p IS NULL GROUP BY 1)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(len(a.gone), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)
"""
