"""Repeated windows of words or bytes, found without a row per window.

Consecutive windows that share their smallest gram (the *anchor*) form one *stretch*.  Equal
windows have equal anchors at equal places, so windows can only be equal inside the same anchor
group, and a group that holds one stretch once is dropped.  A stretch that occurs as a whole
elsewhere settles all its windows with one row.  Stretches that share their anchor with a different
stretch are opened: their text goes to the anchor's task, which sorts the windows that start in it
by passes over successive digits, drops groups of one after each pass and compares what is left
byte by byte.

Every repeated run of windows names its source, and `confirmed` compares the text at both places.

Hot keys: a bounded sample of documents names frequent stretches and anchors beforehand.  Rows of
those stretches are settled where they are read.  Stretches of an anchor whose text, as the sample
foretells it or as a task finds it, exceeds HELD_BYTES or MOST_WINDOWS are opened into rows of single
windows.  Equal ones are settled in the task that reads them, the others are dealt by their own
text, so no task holds an anchor that does not fit.  The result does not depend on the sample.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .tables import cut, drop, prepare, shared

#: Stands for a null id inside this module.
NO_ID = -(2**63)
#: One document in so many is sampled for frequent keys, and at most so many keys are kept.
SAMPLE, HOT_KEYS = 32, 40_000
#: Occurrences in the sample from which a key is frequent.
HOT_COUNT = 12
#: Rows of one anchor that a task keeps at a time.
HELD_ROWS = 200_000
#: Bytes of opened text that are sorted at a time, the most that one anchor may have, and the most windows in them.
SORT_BYTES, HELD_BYTES, MOST_WINDOWS = 1 << 19, 1 << 24, 1_500_000
#: Windows that are hashed at a time, and bytes of text in a step: memory does not grow with a document.
CHUNK, STEP = 1 << 17, 1 << 18
#: Digits by which windows are sorted.
PASSES = 5
SETTLED, OPEN, WIDE = 0, 1, 2
RUN = "doc long, at long, n long, sdoc long, sat long"


@dataclass(frozen=True)
class Shape:
    """What a window is: its unit, its length, and the length of the grams that anchor it."""

    unit: str
    window: int
    gram: int

    def items(self, buf: np.ndarray, offs: np.ndarray):
        """(items to hash, index of each document's first item)."""
        if self.unit == "byte":
            return buf, offs
        starts, ends, first = ts.words(buf, offs)
        return (ts.range_hashes(buf, starts, ends) if len(starts) else np.empty(0, np.uint64)), first

    def plain(self, buf: np.ndarray, offs: np.ndarray):
        """(bytes, start and end of each item in them, first items): words follow each other with one space between."""
        if self.unit == "byte":
            at = np.arange(len(buf) + 1)
            return buf, at[:-1], at[1:], offs
        starts, ends, first = ts.words(buf, offs)
        size = ends - starts
        to = np.cumsum(size + 1) - size - 1
        out = np.full(int((size + 1).sum()), 0x20, np.uint8)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + inside] = buf[np.repeat(starts, size) + inside]
        return out, to, to + size, first


_SUMS = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64)


def stretches(shape: Shape, items: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, place, number of windows, anchor, key, check) of the stretches of one step, in bounded parts."""
    size, w = shape.window, shape.window - shape.gram + 1
    total = len(items) - size + 1
    for a in range(0, max(0, total), CHUNK):
        # one window before tells whether a stretch begins here; a stretch that begins here ends within w more
        lo, hi = max(0, a - 1), min(total, a + CHUNK + w)
        part = items[lo : hi + size - 1]
        runs = ts.Windows(part)
        gram = runs.of(shape.gram)
        at = ts.sliding_argmin(gram, w)
        place = np.arange(lo, hi)
        doc = np.searchsorted(first, place, side="right") - 1
        valid = place + size <= first[doc + 1]
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        s = np.flatnonzero(begins)
        stops = np.append(np.flatnonzero(begins | ~valid), hi - lo)
        mine = (s + lo >= a) & (s + lo < a + CHUNK)
        s = s[mine]
        if not len(s):
            continue
        e = stops[np.searchsorted(stops, s, side="right")]
        whole = runs.of(size)
        key = ts.mix(ts.join(whole[s], whole[e - 1]) + (e - s).astype(np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SUMS[part] if part.dtype == np.uint8 else part, dtype=np.uint64)])
        check = ts.mix(sums[e - 1 + size] - sums[s]) >> np.uint64(40)
        anchor = (gram[at[s]] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        yield doc[s], s + lo - first[doc[s]], e - s, anchor, key.view(np.int64), check.view(np.int64)


def pack_place(check: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    return check << 40 | n << 32 | at


@dataclass
class Hot:
    """Frequent keys of the sample.  sources: for stretches, by key, the (document, place) that stays; anchors: with two stretches at least."""

    keys: np.ndarray
    sdoc: np.ndarray
    sat: np.ndarray
    anchors: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the table, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[k] == keys, k, -1)


def _steps(shape: Shape, batch: pa.RecordBatch):
    """Stretches of a batch (d, text), with ids instead of document numbers."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for i, _, buf, offs in ts.scan(batch.column(1), STEP):
        items, first = shape.items(buf, offs)
        for doc, *rest in stretches(shape, items, first):
            yield ids[i + doc], *rest


#: k: 0 for rows to be grouped, -1 for rows to be opened at once, else one more than the place in the table of hot keys.
ROW = "p int, k int, u long, x long, doc long"


def _emit(shape: Shape, hot: Hot, ordered: bool):
    """Rows of all stretches: settled or open at once where a key is hot, else to be grouped."""

    def run(batches):
        for batch in batches:
            for ids, at, n, anchor, key, check in _steps(shape, batch):
                k = hot.find(key).astype(np.int32) + 1
                if ordered and (k > 0).any():
                    k[(k > 0) & (ids <= hot.sdoc[k - 1])] = 0
                elif (k > 0).any():  # the source is repeated as well, and also stands for its key in its anchor's group
                    source = np.flatnonzero((k > 0) & (ids == hot.sdoc[k - 1]) & (at == hot.sat[k - 1]))
                    twice = np.append(np.arange(len(ids)), source)
                    ids, at, n, anchor, key, check, k = (v[twice] for v in (ids, at, n, anchor, key, check, k))
                    k[len(k) - len(source) :] = 0
                if len(hot.anchors):
                    k[np.isin(anchor, hot.anchors) & (k == 0)] = -1
                free = k != 0
                part = anchor.copy()
                part[free] = (key[free] ^ (ids[free] * 0x9E3779B1 + at[free])) & 0x7FFFFFFF
                out = pa.RecordBatch.from_arrays([pa.array(part), pa.array(k), pa.array(key), pa.array(pack_place(check, n, at)), pa.array(ids)], names=["p", "k", "u", "x", "doc"])
                for z in range(0, len(out), 50_000):
                    yield out.slice(z, 50_000)

    return run


GROUPS = f"{RUN}, h int, kind int"


def _rows(doc, at, n, sdoc, sat, h, kind):
    cols = [np.broadcast_to(c, len(doc)) for c in (doc, at, n, sdoc, sat)]
    return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols), pa.array(np.broadcast_to(h, len(doc)).astype(np.int32)), pa.array(np.full(len(doc), kind, np.int32))], names=["doc", "at", "n", "sdoc", "sat", "h", "kind"])


def _group(hot: Hot, ordered: bool):
    """Settles or opens the stretches of each anchor; rows come sorted by p, u, doc, x.

    Only the rows of an anchor that may go on are kept between batches.  An anchor with more than
    HELD_ROWS rows is handled in parts, each of which opens the sources of its own stretches: opened
    stretches are compared window by window, so the result is the same.
    """

    def decide(h, u, x, doc, forced):
        n = len(h)
        new_h = np.append(True, h[1:] != h[:-1])
        new_u = new_h | np.append(True, u[1:] != u[:-1])
        start = np.maximum.accumulate(np.where(new_u, np.arange(n), 0))
        group, run = np.cumsum(new_h) - 1, np.cumsum(new_u) - 1
        differ = np.bincount(run, weights=(x >> 40) != (x[start] >> 40))[run] > 0  # rows that agree in the key but not in the check
        several = (np.bincount(group, weights=new_u)[group] >= 2) | forced | (np.bincount(group, weights=differ)[group] > 0)
        if ordered:
            settled = ~differ & (doc > doc[start])
            opened, source = ~settled & several, start
        else:
            settled = ~differ & (np.bincount(run)[run] >= 2)
            opened = (~settled | (np.arange(n) == start)) & several
            source = np.where(np.arange(n) == start, np.minimum(start + 1, n - 1), start)
        at, size = x & 0xFFFFFFFF, x >> 32 & 0xFF
        if settled.any():
            s = source[settled]
            yield _rows(doc[settled], at[settled], size[settled], doc[s], at[s], h[settled], SETTLED)
        if opened.any():
            yield _rows(doc[opened], at[opened], size[opened], 0, 0, h[opened], OPEN)

    def run(batches):
        held, split = None, None
        for batch in _with_end(_gathered(batches)):
            if batch is not None:
                p, k, u, x, doc = (c.to_numpy() for c in batch.columns)
                at, size = x & 0xFFFFFFFF, x >> 32 & 0xFF
                if (k > 0).any():
                    m = k > 0
                    s = k[m] - 1
                    # the source itself is repeated too; its own place stands for the others
                    yield _rows(doc[m], at[m], size[m], hot.sdoc[s], hot.sat[s], p[m], SETTLED)
                if (k < 0).any():
                    yield _rows(doc[k < 0], at[k < 0], size[k < 0], 0, 0, p[k < 0], WIDE)
                cols = [c[k == 0] for c in (p, u, x, doc)]
                cols = cols if held is None else [np.concatenate(c) for c in zip(held, cols, strict=True)]
            else:
                cols = held
            held = None
            if cols is None or not len(cols[0]):
                continue
            h = cols[0]
            cut_at = len(h)
            forced = (h == split) if split is not None else np.zeros(len(h), bool)
            if batch is not None:
                first = int(np.flatnonzero(h == h[-1])[0])  # rows are sorted, so these are the last ones
                if len(h) - first <= HELD_ROWS:
                    cut_at = first
                    held = [c[first:] for c in cols]
                else:
                    split = h[-1]
                    forced[first:] = True
            if cut_at:
                yield from decide(*(c[:cut_at] for c in cols), forced[:cut_at])

    return run


def _gathered(batches, rows: int = 50_000):
    """Joins small batches, so that array operations pay."""
    have, n = [], 0
    for b in _with_end(batches):
        if b is not None:
            have.append(b)
            n += len(b)
        if n and (b is None or n >= rows):
            yield pa.Table.from_batches(have).combine_chunks().to_batches(max_chunksize=n)[0]
            have, n = [], 0


def _with_end(batches):
    yield from batches
    yield None


def _sampled_keys(shape: Shape):
    def run(batches):
        for batch in batches:
            for ids, at, n, anchor, key, _ in _steps(shape, batch):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(key), pa.array(ids), pa.array(at)], names=["h", "u", "doc", "at"])

    return run


def _firsts(shape: Shape, keys: np.ndarray):
    """The smallest (document, place) of each of some keys within a part."""

    def run(batches):
        hot = Hot(keys, keys, keys, np.empty(0, np.int32))
        doc, place = np.full(len(keys), 2**63 - 1), np.full(len(keys), 2**63 - 1)
        for batch in batches:
            for ids, at, _, _, key, _ in _steps(shape, batch):
                k = hot.find(key)
                k, ids, at = k[k >= 0], ids[k >= 0], at[k >= 0]
                order = np.lexsort((at, ids, k))
                k, ids, at = k[order], ids[order], at[order]
                lead = np.append(True, k[1:] != k[:-1]) if len(k) else np.empty(0, bool)
                k, ids, at = k[lead], ids[lead], at[lead]
                less = (ids < doc[k]) | ((ids == doc[k]) & (at < place[k]))
                doc[k[less]], place[k[less]] = ids[less], at[less]
        seen = np.flatnonzero(doc < 2**63 - 1)
        yield pa.RecordBatch.from_arrays([pa.array(keys[seen]), pa.array(doc[seen]), pa.array(place[seen])], names=["u", "doc", "at"])

    return run


def hot_keys(docs: DataFrame, shape: Shape, ordered: bool) -> Hot:
    """Frequent stretches and anchors of a sample of documents; at most HOT_KEYS of each reach the driver.

    Ordered: the source of a stretch is its smallest document, found by one more reading of all
    documents.  Unordered: any occurrence serves, so the sample's smallest is taken.
    """
    sample = docs.where(F.pmod(F.xxhash64("d"), F.lit(SAMPLE)) == 0).mapInArrow(_sampled_keys(shape), "h int, u long, doc long, at long")
    per = cut(sample.groupBy("h", "u").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first")), "sample")
    large = max(HOT_COUNT, HELD_BYTES // (SAMPLE * shape.window * (1 if shape.unit == "byte" else 7)))
    anchors = [r["h"] for r in per.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= large).orderBy(F.desc("n"), "h").limit(HOT_KEYS).select("h").collect()]
    got = per.where(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "u").limit(HOT_KEYS).select("u", "first.doc", "first.at").collect()
    drop(per)
    rows = sorted({r["u"]: (r["doc"], r["at"]) for r in got}.items())
    keys = np.array([u for u, _ in rows], np.int64)
    if ordered and len(keys):
        found = docs.mapInArrow(_firsts(shape, keys), "u long, doc long, at long").groupBy("u").agg(F.min(F.struct("doc", "at")).alias("first")).select("u", "first.doc", "first.at").collect()
        rows = sorted((r["u"], (r["doc"], r["at"])) for r in found)
    return Hot(np.array([u for u, _ in rows], np.int64), np.array([v[0] for _, v in rows], np.int64), np.array([v[1] for _, v in rows], np.int64), np.array(sorted(anchors), np.int32))


def slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges as a column."""
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(starts - offs[:-1], size) + np.arange(offs[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _places(shape: Shape, batch: pa.RecordBatch, lists: int):
    """Per step of (d, text, lists ...): ids, what `Shape.plain` gives, documents, and flat lists; places outside a text go."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for i, j, buf, offs in ts.scan(batch.column(1), STEP):
        cols = [batch.column(2 + k).slice(i, j - i) for k in range(lists)]
        doc = np.repeat(np.arange(j - i), np.diff(cols[0].offsets.to_numpy()))
        if not len(doc):
            continue
        plain, starts, ends, first = shape.plain(buf, offs)
        flat = [c.flatten().to_numpy() for c in cols]
        ok = first[doc] + flat[0] + flat[1] + shape.window - 1 <= first[doc + 1]  # rows with equal ids may differ in text
        yield ids[i + doc[ok]], plain, starts, ends, first[doc[ok]], [f[ok] for f in flat]


def _expose(shape: Shape):
    """The text of opened stretches."""

    def run(batches):
        for batch in batches:
            for ids, plain, starts, ends, first, (at, n, h) in _places(shape, batch, 3):
                for z in range(0, len(ids), 2000):
                    s = slice(z, z + 2000)
                    a = first[s] + at[s]
                    raw = slices(plain, starts[a], ends[a + n[s] + shape.window - 2])
                    yield pa.RecordBatch.from_arrays([pa.array(h[s].astype(np.int32)), pa.array(ids[s]), pa.array(at[s]), pa.array(n[s]), raw], names=["h", "doc", "at", "n", "raw"])

    return run


def sorted_windows(shape: Shape, buf: np.ndarray, offs: np.ndarray, n: np.ndarray, group: np.ndarray):
    """Equal windows of some texts: (text, place) of each window that is not alone, and the place of its group's first and last in that list.

    n: windows of each text; only windows of one `group` can be equal.  Windows are ordered by
    PASSES digits from the most significant one; groups of one go after each pass, and those left
    after the last are compared byte by byte.
    """
    items, first = shape.items(buf, offs)
    text = np.repeat(np.arange(len(n), dtype=np.int32), n)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    pos, gid = first[text] + at, group[text].astype(np.uint64)
    live = np.arange(len(text))
    ends = [shape.window * (p + 1) // PASSES for p in range(PASSES)]
    widths = [(e, e - d) for d, e in zip([0, *ends], ends) if e > d]
    digits = np.empty((len(widths), len(text)), np.uint64)
    for lo in range(0, len(items), CHUNK):  # windows come in the order of their places
        a, b = np.searchsorted(pos, (lo, lo + CHUNK))
        if a < b:
            runs = ts.Windows(items[lo : lo + CHUNK + shape.window])
            for k, (end, width) in enumerate(widths):
                digits[k, a:b] = runs.of(width)[pos[a:b] - lo + end - width]
    for digit in digits:
        key = ts.join(ts.mix(gid), digit[live])
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.empty(0, bool)
        number = np.cumsum(new) - 1
        keep = np.bincount(number, minlength=1)[number] > 1
        live, gid = live[order[keep]], number[keep].astype(np.uint64)
    del digits
    if not len(live):
        e = np.empty(0, np.int64)
        return e, e, e, e
    order = np.lexsort((live, gid))
    live, gid = live[order], gid[order]
    plain, starts, ends, _ = shape.plain(buf, offs)
    a, b = starts[pos[live]], ends[pos[live] + shape.window - 1]
    new = np.append(True, gid[1:] != gid[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (b - a == b[lead] - a[lead]) & (group[text[live]] == group[text[live[lead]]])
    same &= ts.equal_ranges(plain, a, a[lead], np.where(same, b - a, 0))
    if not same.all():  # one digit hash, several texts: told apart by their bytes
        table: dict = {}
        raw = plain.tobytes()
        gid = np.array([table.setdefault((raw[s:e], g), len(table)) for s, e, g in zip(a.tolist(), b.tolist(), group[text[live]].tolist(), strict=True)], np.int64)
        keep = np.bincount(gid)[gid] > 1
        live, gid = live[keep], gid[keep]
        order = np.lexsort((live, gid))
        live, gid = live[order], gid[order]
        if not len(live):
            return live, live, live, live
        new = np.append(True, gid[1:] != gid[:-1])
    begin = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    end = np.append(begin[1:], len(live)) - 1
    return text[live], at[live], begin[number], end[number]


def merged(doc, at, n, sdoc, sat) -> tuple[np.ndarray, ...]:
    """Runs of windows that go on in the document and in the source become one; rows may overlap."""
    order = np.lexsort((at, sat - at, sdoc, doc))
    doc, at, n, sdoc, sat = (v[order] for v in (doc, at, n, sdoc, sat))
    if not len(doc):
        return doc, at, n, sdoc, sat
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (sdoc[1:] != sdoc[:-1]) | ((sat - at)[1:] != (sat - at)[:-1]))
    # ends grow within one shift once each shift is lifted above those before it
    lift = np.cumsum(fresh) * (1 << 33)
    reach = np.maximum.accumulate(at + n + lift)
    new = fresh | np.append(True, (at + lift)[1:] > reach[:-1])
    s = np.flatnonzero(new)
    stop = reach[np.append(s[1:], len(doc)) - 1] - lift[s]
    return doc[s], at[s], stop - at[s], sdoc[s], sat[s]


def _sort(shape: Shape, ordered: bool):
    """Runs of equal windows of each anchor; rows (h, doc, at, n, raw) come sorted by h, doc, at."""

    def settle(h, doc, at, n, raw):
        if ordered:  # a window of an anchor that one document holds alone has no smaller one
            new = np.append(True, h[1:] != h[:-1])
            number = np.cumsum(new) - 1
            begin = np.flatnonzero(new)
            more = (doc[np.append(begin[1:], len(h)) - 1] > doc[begin])[number]
            h, doc, at, n = h[more], doc[more], at[more], n[more]
            raw = raw.filter(pa.array(more))
        if not len(h):
            return
        buf, offs = _binary(raw)
        text, k, lead, last = sorted_windows(shape, buf, offs, n, h)
        if not len(text):
            return
        d, a = doc[text], at[text] + k
        mine = np.arange(len(text))
        if ordered:
            src, ok = lead, d > d[lead]
        else:
            src, ok = np.where(mine == lead, last, lead), np.ones(len(text), bool)
        out = merged(d[ok], a[ok], np.ones(int(ok.sum()), np.int64), d[src][ok], a[src][ok])
        if len(out[0]):
            yield _rows(*out, 0, SETTLED)

    def run(batches):
        held, size, wide = [], 0, None
        for batch in _with_end(batches):
            if batch is not None:
                if wide is not None:  # more of an anchor that is too large for a task
                    same = batch.column(0).to_numpy() == wide
                    k = int(same.sum())
                    if k:
                        yield _widened(batch.slice(0, k))
                        batch = batch.slice(k)
                    if not len(batch):
                        continue
                    wide = None
                held.append(batch)
                size += batch.column(4).nbytes
                if size < SORT_BYTES:
                    continue
            if not held:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            h = t.column(0).to_numpy()
            cut_at = len(t) if batch is None else int(np.flatnonzero(h == h[-1])[0])
            if cut_at:
                part = t.slice(0, cut_at)
                yield from settle(h[:cut_at], *(part.column(c).to_numpy() for c in (1, 2, 3)), part.column(4).combine_chunks())
            held, rest = [], t.slice(cut_at)
            size = rest.column(4).nbytes if len(rest) else 0
            if len(rest) and (size > HELD_BYTES or int(rest.column(3).to_numpy().sum()) > MOST_WINDOWS):
                wide, size = h[-1], 0
                yield from map(_widened, rest.to_batches())
            elif len(rest):
                held = rest.combine_chunks().to_batches()

    return run


def _widened(batch: pa.RecordBatch) -> pa.RecordBatch:
    return _rows(*(batch.column(c).to_numpy() for c in (1, 2, 3)), 0, 0, 0, WIDE)


def _binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


#: Windows that a task holds to settle equal ones among them before they are dealt.
HELD_WINDOWS = 100_000
#: kind SETTLED: (doc, at) repeats (sdoc, sat); WIDE: to be dealt by its text, u and c.
SINGLE = "u long, c int, doc long, at long, n long, sdoc long, sat long, kind int"


def _singles(u, c, doc, at, n, sdoc, sat, kind):
    cols = [np.broadcast_to(v, len(doc)).astype(np.int64) for v in (u, c, doc, at, n, sdoc, sat)]
    return pa.RecordBatch.from_arrays([pa.array(v) if k != 1 else pa.array(v.astype(np.int32)) for k, v in enumerate(cols)] + [pa.array(np.full(len(doc), kind, np.int32))], names=["u", "c", "doc", "at", "n", "sdoc", "sat", "kind"])


def _equals(u, c, doc, at, ordered: bool):
    """Of windows sorted by u, c, doc, at: the first and another of each one's group, and whether the window is repeated."""
    new = np.append(True, (u[1:] != u[:-1]) | (c[1:] != c[:-1]))
    number = np.cumsum(new) - 1
    lead = np.flatnonzero(new)[number]
    if ordered:
        return lead, lead, doc > doc[lead]
    size = np.bincount(number)[number]
    return lead, np.where(np.arange(len(u)) == lead, np.minimum(lead + 1, len(u) - 1), lead), size > 1


def _windows(shape: Shape, ordered: bool):
    """The windows of some stretches; equal ones that a task sees together are settled, and one of them stands for them."""

    def settle(rows):
        u, c, doc, at = (np.concatenate(v) for v in zip(*rows, strict=True))
        order = np.lexsort((at, doc, c, u))
        u, c, doc, at = u[order], c[order], doc[order], at[order]
        lead, other, twice = _equals(u, c, doc, at, ordered)
        left = ~twice if ordered else ~twice | (np.arange(len(u)) == lead)
        if twice.any():
            runs = merged(doc[twice], at[twice], np.ones(int(twice.sum()), np.int64), doc[other[twice]], at[other[twice]])
            yield _singles(0, 0, *runs, SETTLED)
        yield _singles(u[left], c[left], doc[left], at[left], 1, 0, 0, WIDE)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for ids, plain, starts, ends, first, (at, n) in _places(shape, batch, 2):
                for z in range(0, len(ids), 500):
                    s = slice(z, z + 500)
                    m = n[s]
                    place = np.repeat(at[s], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                    a = np.repeat(first[s], m) + place
                    lo, hi = int(a.min()), int(a.max()) + shape.window
                    items = plain[lo:hi] if shape.unit == "byte" else ts.range_hashes(plain, starts[lo:hi], ends[lo:hi])
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SUMS[items] if items.dtype == np.uint8 else items, dtype=np.uint64)])
                    key = ts.Windows(items).of(shape.window)[a - lo]
                    check = ts.mix(sums[a - lo + shape.window] - sums[a - lo]) >> np.uint64(40)
                    rows.append((key.view(np.int64), check.view(np.int64), np.repeat(ids[s], m), place))
                    held += len(place)
                    if held >= HELD_WINDOWS:
                        yield from settle(rows)
                        rows, held = [], 0
        if rows:
            yield from settle(rows)

    return run


def _dealt_windows(ordered: bool):
    """Settles windows that come sorted by u, c, doc, at; of an earlier batch only the first of its last group is kept."""

    def run(batches):
        kept, known = None, False  # that window, and whether it is settled
        for batch in _gathered(batches):
            u, c, doc, at = (batch.column(k).to_numpy() for k in range(4))
            more = kept is not None
            if more:
                u, c, doc, at = (np.append(k, v) for k, v in zip(kept, (u, c, doc, at), strict=True))
            lead, other, twice = _equals(u, c, doc, at, ordered)
            z = int(lead[-1])
            kept, known_next = tuple(v[z] for v in (u, c, doc, at)), bool(twice[-1]) or (known if more and z == 0 else False)
            if more and (known or ordered):
                twice[0] = False
            known = known_next
            if twice.any():
                yield _rows(doc[twice], at[twice], 1, doc[other[twice]], at[other[twice]], 0, SETTLED)

    return run


def prepared(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """(d, text): the id, with a stand-in for null, and the text; and further columns."""
    prepare(docs.sparkSession)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.col(text_col).cast("string").alias("text"), *more)


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stored(docs: DataFrame) -> DataFrame:
    """The table (d, text, ...), written to the shared folder in buckets of d: texts are shuffled once, and lists of places come to them."""
    n, name = parts(docs), f"quarry_{uuid.uuid4().hex}"
    path = f"{shared(docs.sparkSession).rstrip('/')}/quarry/{name}"
    docs.repartition(n, "d").write.bucketBy(n, "d").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return docs.sparkSession.table(name)


def listed_rows(rows: DataFrame, *cols: str, key: str = "doc") -> DataFrame:
    """(d, l): the rows of each document as a list."""
    return rows.groupBy(F.col(key).alias("d")).agg(F.collect_list(F.struct(*cols)).alias("l"))


def listed(docs: DataFrame, rows: DataFrame, *cols: str, how: str = "inner", lead="d", key: str = "doc") -> DataFrame:
    """(lead, text, a list of each column): each document with its rows; with how = 'left', empty lists where it has none."""
    got = docs.join(listed_rows(rows, *cols, key=key), "d", how)
    return got.select(lead, "text", *(F.coalesce(F.col(f"l.{c}"), F.array().cast(f"array<{rows.schema[c].dataType.simpleString()}>")).alias(c) for c in cols))


def repeated(docs: DataFrame, shape: Shape, ordered: bool) -> DataFrame:
    """Runs of repeated windows: doc, at, n (windows from `at` on), and (sdoc, sat), where the same text starts.

    docs: (d, text) of `stored`.  Ordered: a window counts if its text also starts in a document
    with a smaller d, the source is the first such place; unordered: if it also starts anywhere else.
    """
    hot = hot_keys(docs, shape, ordered)
    n = parts(docs)
    dealt = docs.mapInArrow(_emit(shape, hot, ordered), ROW).repartition(n, "p").sortWithinPartitions("p", "u", "doc", "x")
    first = cut(dealt.mapInArrow(_group(hot, ordered), GROUPS), "stretches")
    exposed = listed(docs, first.where(F.col("kind") == OPEN), "at", "n", "h").mapInArrow(_expose(shape), "h int, doc long, at long, n long, raw binary")
    sort = cut(exposed.repartition(n, "h").sortWithinPartitions("h", "doc", "at").mapInArrow(_sort(shape, ordered), GROUPS), "sorted")
    both = first.unionByName(sort)
    wide = listed(docs, both.where(F.col("kind") == WIDE), "at", "n")
    single = cut(wide.mapInArrow(_windows(shape, ordered), SINGLE), "windows")
    left = single.where(F.col("kind") == WIDE).select("u", "c", "doc", "at")
    hits = left.repartition(n, "u").sortWithinPartitions("u", "c", "doc", "at").mapInArrow(_dealt_windows(ordered), GROUPS)
    seen = single.where(F.col("kind") == SETTLED).select("doc", "at", "n", "sdoc", "sat")
    return both.where(F.col("kind") == SETTLED).drop("h", "kind").unionByName(seen).unionByName(hits.drop("h", "kind"))


def _glue(batches):
    for batch in batches:
        doc = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
        flat = [batch.column(k).flatten().to_numpy() for k in (1, 2, 3, 4)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged(doc, *flat)], names=["doc", "at", "n", "sdoc", "sat"])


def glued(runs: DataFrame) -> DataFrame:
    """Runs that go on in their document and in their source become one."""
    lists = runs.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "sdoc", "sat")).alias("l"))
    return lists.select("doc", *(F.col(f"l.{c}").alias(c) for c in ("at", "n", "sdoc", "sat"))).mapInArrow(_glue, RUN)


def digests(plain: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[bytes]:
    """A BLAKE2 digest of items [a, b) of each pair."""
    raw = plain.tobytes()
    return [hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts[a].tolist(), ends[b - 1].tolist(), strict=True)]


def _sources(shape: Shape):
    def run(batches):
        for batch in batches:
            for ids, plain, starts, ends, first, (at, n) in _places(shape, batch, 2):
                g = digests(plain, starts, ends, first + at, first + at + n + shape.window - 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at), pa.array(n), pa.array(g, pa.binary())], names=["sdoc", "sat", "n", "g"])

    return run


def confirmed(docs: DataFrame, shape: Shape, runs: DataFrame) -> DataFrame:
    """(doc, at, n, g): runs with the digest of the text that stands at their source; `covered` compares it with their own.

    A source that many runs share is read once.  Runs whose source lies outside its text go.
    """
    asked = runs.select("sdoc", "sat", "n").distinct()
    found = listed(docs, asked, "sat", "n", key="sdoc").mapInArrow(_sources(shape), "sdoc long, sat long, n long, g binary").distinct()
    return cut(runs.join(found, ["sdoc", "sat", "n"]).select("doc", "at", "n", "g"), "confirmed")


def covered(shape: Shape, buf: np.ndarray, offs: np.ndarray, at: pa.Array, n: pa.Array, g: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first item of each document, items that confirmed runs cover): a run counts if its own text has the digest of its source."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at.offsets.to_numpy()))
    if not len(doc):
        first = offs if shape.unit == "byte" else ts.words(buf, offs)[2]
        return first, np.zeros(int(first[-1]), bool)
    plain, starts, ends, first = shape.plain(buf, offs)
    at, n, g = at.flatten().to_numpy(), n.flatten().to_numpy(), np.array(g.flatten().to_pylist(), object)
    ok = first[doc] + at + n + shape.window - 1 <= first[doc + 1]
    s, g = (first[doc] + at)[ok], g[ok]
    e = s + n[ok] + shape.window - 1
    ok = np.array([x == y for x, y in zip(digests(plain, starts, ends, s, e), g, strict=True)], bool) if len(s) else np.empty(0, bool)
    step = np.bincount(s[ok], minlength=len(starts) + 1) - np.bincount(e[ok], minlength=len(starts) + 1)
    return first, np.cumsum(step)[:-1] > 0


def marked(batch: pa.RecordBatch, *shapes: Shape):
    """(bytes, offsets, and for each shape what `covered` gives) for each step of (lead, text, at, n, g, at, n, g, ...)."""
    for i, j, buf, offs in ts.scan(batch.column(1), STEP):
        lists = [c.slice(i, j - i) for c in batch.columns[2:]]
        yield buf, offs, [covered(sh, buf, offs, *lists[3 * k : 3 * k + 3]) for k, sh in enumerate(shapes)]
