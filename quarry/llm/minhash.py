"""Near-duplicate detection with circulant MinHash, banding and exact verification.

A signature needs two permutations of a fixed universe: the first scatters the shingles, the second
is shifted circularly by one place for each further coordinate.  Bands of coordinates give buckets;
every member of a bucket is tied to the bucket's smallest member, which gathers candidates in
clusters without making pairs.  Inside a cluster, in blocks of bounded size, all intersections of
full shingle sets are counted at once by a matrix product, and only links that join something new
leave the task.  The components of those links are the groups.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .components import components
from .tables import cut, documents, prepare

SHINGLE = 5
#: The universe that shingles are mapped to, as a power of two.
UNIVERSE_BITS = 18
#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-6
#: Members of a block: a task compares at most two blocks at a time.
BLOCK = 1024
#: Cells of the largest membership matrix that a task makes at a time.
CELLS = 1 << 23
NO_ID = -(2**63)


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, coordinates in a band) so that pairs at the threshold are missed with chance MISS at most."""
    j = percent / 100
    rows = max(1, min(8, round(-0.97 / math.log(j)))) if j < 1 else 8
    hit = j**rows
    return (max(1, math.ceil(math.log(MISS) / math.log1p(-hit))) if hit < 1 else 1), rows


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the shifted one written twice so that a shift is a slice."""
    rng = np.random.default_rng(31337)
    n = 1 << UNIVERSE_BITS
    second = rng.permutation(n).astype(np.int32)
    return rng.permutation(n).astype(np.int32), np.concatenate([second, second])


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index of each document's first): the distinct shingles of each document, in ascending order.

    Words are lower-cased in A to Z; a document of fewer than k words is one shingle, without words none.
    """
    buf = ts.LOWER[buf]
    starts, ends, first = ts.words(buf, offs)
    n = len(offs) - 1
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    word = ts.range_hashes(buf, starts, ends)
    size = np.diff(first)
    last = np.repeat(first[1:], size)  # one after the last word of the document
    at = np.arange(len(starts))
    whole = at + k <= last
    short = (at == np.repeat(first[:-1], size)) & ~whole
    keep = np.flatnonzero(whole | short)
    h, left = word[keep], last[keep] - keep
    for j in range(1, k):  # a short document ends its shingle with a mark for each missing word
        h = ts.join(h, np.where(left > j, word[np.minimum(keep + j, len(word) - 1)], np.uint64(j)))
    h = ts.mix(h)
    doc = ts.of_docs(first)[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
    return h[new], np.searchsorted(doc[new], np.arange(n + 1))


def signatures(h: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """Signature of each document that has shingles (the rest are left out), 16 bits a coordinate."""
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.empty((len(some), coordinates), np.uint16)
    if not len(some):
        return out
    scatter, shifted = permutations()
    n = 1 << UNIVERSE_BITS
    place = scatter[(h & np.uint64(n - 1)).astype(np.int64)]
    starts = first[some]
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(np.take(shifted[n - k : 2 * n - k], place), starts).astype(np.uint16)
    return out


def digests(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, from sums over their members."""
    add = lambda x: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])[first])
    return add(ts.mix(h ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64), add(ts.mix(h ^ np.uint64(0x14057B7EF767814F))).view(np.int64)


def _sign(bands: int, rows: int):
    def run(batches):
        names = ["d", "n", "s1", "s2", "sig"]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in ts.scan(batch.column(1)):
                h, first = shingle_sets(buf, offs)
                size = np.diff(first)
                a, b = digests(h, first)
                sig = iter(signatures(h, first, bands * rows))
                raw = [next(sig).tobytes() if n else None for n in size.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(size, pa.int64()), pa.array(a), pa.array(b), pa.array(raw, pa.binary())], names=names)

    return run


def _buckets(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), sig.shape[:2]).copy()
            for k in range(rows):
                key = ts.mix(key ^ sig[:, :, k])
            ids = np.repeat(batch.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([ts.as_signed(np.ascontiguousarray(key).ravel()), pa.array(ids)], names=["bucket", "d"])

    return run


def _sets(batches):
    """Full shingle sets of the members of clusters."""
    names = ["cluster", "d", "block", "blocks", "items"]
    for batch in batches:
        want = batch.column(2).to_numpy()
        for i, j, buf, offs in ts.scan(batch.column(1)):
            h, first = shingle_sets(buf, offs)
            a, _ = digests(h, first)
            same = np.flatnonzero(a == want[i:j])  # rows that share an id may differ in text
            blobs = [h[first[k] : first[k + 1]].tobytes() for k in same.tolist()]
            part = batch.slice(i, j - i).take(pa.array(same))
            yield pa.RecordBatch.from_arrays([part.column(3), part.column(0), part.column(4), part.column(5), pa.array(blobs, pa.binary())], names=names)


def linked_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs a < b with 100 * intersection >= percent * union, by products of membership matrices."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        ok = 100 * common >= percent * (size.sum() - common)
        return (np.array([0]), np.array([1])) if ok else (np.empty(0, np.int64),) * 2
    items, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    shared = np.bincount(column, minlength=len(items)) > 1
    index = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = index[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((m, m), np.float32)
    width = max(1, CELLS // m)
    for a in range(0, int(shared.sum()), width):
        s = slice(*np.searchsorted(column, [a, a + width]))
        x = np.zeros((m, min(width, int(shared.sum()) - a)), np.float32)
        x[owner[s], column[s] - a] = 1
        common += x @ x.T  # counts stay exact below 2**24
    both = common.astype(np.int64)
    ok = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
    return np.nonzero(ok)


def forest(m: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what was apart."""
    root = list(range(m))

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _verify(percent: int):
    """Links of each group (cluster, low, high) of rows that come sorted by group."""

    def decide(ids, blobs):
        seen = dict(zip(ids, blobs, strict=True))
        nodes = sorted(seen)
        if len(nodes) < 2:
            return []
        a, b = linked_pairs([np.frombuffer(seen[d], np.uint64) for d in nodes], percent)
        return [(nodes[x], nodes[y]) for x, y in forest(len(nodes), a, b)]

    def run(batches):
        group, ids, blobs = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            links = []
            for key, d, blob in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if key != group:
                    links += decide(ids, blobs)
                    group, ids, blobs = key, [], []
                ids.append(d)
                blobs.append(blob)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["u", "v"])
        links = decide(ids, blobs)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach) and kept (it is the row's own id).

    Documents are linked if 100 * intersection >= percent * union of their distinct five-word
    shingles.  Null and empty texts, and texts without words, have no shingle and are linked with
    nothing; equal sets are one node from the start.  Rows that share an id are one node of the
    graph and each give a row.  A row without an id is linked with nothing and kept.  Other columns
    are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    bands, rows = bands_for(percent)
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.col(text_col).cast("string").alias("text"))
    signed = cut(src.mapInArrow(_sign(bands, rows), "d long, n long, s1 long, s2 long, sig binary"), "signatures")
    linkable = signed.where((F.col("n") > 0) & (F.col("d") != NO_ID))
    equal = linkable.groupBy("s1", "s2", "n").agg(F.min("d").alias("rep"), F.max("d").alias("most"), F.count("*").alias("k"))
    # one row of each set: the smallest id, and of rows that agree in id and set any one
    reps = cut(linkable.groupBy("s1", "s2", "n").agg(F.min_by("sig", "d").alias("sig"), F.min("d").alias("d")), "sets")
    same = linkable.join(equal.where("most > rep").select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).where("d > rep").select(F.col("d").alias("u"), F.col("rep").alias("v"))

    members = cut(reps.select("d", "sig").mapInArrow(_buckets(bands, rows), "bucket long, d long"), "buckets")
    pivots = members.groupBy("bucket").agg(F.min("d").alias("pivot"), F.max("d").alias("most")).where("most > pivot")
    tied = members.join(pivots, "bucket").where("d > pivot").select(F.col("d").alias("u"), F.col("pivot").alias("v")).distinct()
    clusters = cut(components(tied), "clusters")
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = clusters.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    wanted = reps.select(F.col("d").alias("node"), "s1").join(placed, "node")
    full = src.join(wanted.withColumnRenamed("node", "d"), "d").select("d", "text", "s1", "component", "block", "blocks")
    items = cut(full.mapInArrow(_sets, "cluster long, d long, block long, blocks long, items binary"), "items")
    # every block meets every block of its cluster once
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = items.withColumn("o", other).select("cluster", F.least("block", "o").alias("low"), F.greatest("block", "o").alias("high"), "d", "items")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = paired.repartition(parts, "cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    links = dealt.mapInArrow(_verify(percent), "u long, v long")
    groups = components(links.unionByName(same))
    found = signed.select("d", F.col("n").alias("n_shingles")).join(groups.withColumnRenamed("node", "d"), "d", "left")
    component = F.when(F.col("d") != NO_ID, F.coalesce("component", "d"))
    return found.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("d"), F.lit(True)).alias("kept"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS node, u AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach),
g AS (SELECT node, min(reach) AS component FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(g.component, w.doc_id) AS component_id, coalesce(g.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN g ON g.node = w.doc_id
"""
