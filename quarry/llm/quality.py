"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit per
failed rule; a policy is a versioned mask over those bits, so another policy, or the effect of
leaving a rule out, is a bitwise operation on the ledger and never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .tables import carried, documents, prepare, uncarried

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COLUMNS = ", ".join(f"{k} long" for k in (*MEASURES, "n_lines"))
#: Fixed values of the contract: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger and the SQL condition on the measurements under which it fails."""

    bit: int
    name: str
    fails: str


#: Rules compare whole numbers only, so every engine agrees on every document.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "words_too_short", "word_chars < 2 * n_words"),
    Rule(3, "words_too_long", "word_chars > 15 * n_words"),
    Rule(4, "too_many_symbols", "10 * n_symbols > n_words"),
    Rule(5, "duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document is kept unless a bit of the mask is set."""

    version: str
    mask: int


def mask_of(*names: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


POLICIES = {
    "base": Policy("base", mask_of("too_few_words", "repeated_phrases")),
    "v1": Policy("v1", mask_of("too_few_words", "repeated_phrases", "words_too_short", "words_too_long", "too_many_symbols", "duplicate_lines")),
}


def _same_before(doc: np.ndarray, h: np.ndarray, equal) -> tuple[np.ndarray, np.ndarray]:
    """For items in text order: whether an equal one of the same document came before, and whether any equal one exists.

    equal(i, j): whether items i and j have the same text; hashes only bring candidates together.
    """
    order = np.argsort(h, kind="stable")
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    near = np.flatnonzero(again)
    if len(near) and not equal(order[near], order[near + 1]).all():  # one hash, several texts: told apart by number
        number, seen = np.arange(len(h), dtype=np.uint64), {}
        for i in order.tolist():
            firsts = seen.setdefault((int(doc[i]), int(h[i])), [])
            j = next((f for f in firsts if equal(np.array([f]), np.array([i]))[0]), None)
            if j is None:
                firsts.append(i)
            else:
                number[i] = j
        return _same_before(doc, number, lambda i, j: np.ones(len(i), bool))
    before = np.zeros(len(h), bool)
    before[order[1:]] = again
    either = before.copy()
    either[order[:-1]] |= again
    return before, either


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each document of one step."""
    n = len(offs) - 1
    starts, ends, first = ts.words(buf, offs)
    n_words = np.diff(first)
    add = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    out = {"n_words": n_words}
    out["word_chars"] = add(~ts.SPACE[buf] & ((buf & 0xC0) != 0x80))
    table = np.zeros(256, bool)
    table[list(SYMBOLS.encode())] = True
    out["n_symbols"] = add(table[buf])

    eight = ts.octets(buf)
    # lines: between line feeds; only those that hold a word count
    cuts = np.unique(np.concatenate([offs[:-1], np.flatnonzero(buf == 0x0A) + 1, [len(buf)]]))
    cuts = cuts[cuts <= len(buf)]
    a, b = cuts[:-1], cuts[1:]
    doc = np.searchsorted(offs, a, side="right") - 1
    b = np.where((b > a) & (buf[np.maximum(b - 1, 0)] == 0x0A), b - 1, b) if len(buf) else b
    worded = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b, doc = a[worded], b[worded], doc[worded]
    same_line = lambda i, j: (b[i] - a[i] == b[j] - a[j]) & ts.equal_ranges(buf, a[i], a[j], np.minimum(b[i] - a[i], b[j] - a[j]), eight)
    again, _ = _same_before(doc, ts.range_hashes(buf, a, b, eight), same_line)
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n)

    # three-word windows inside one document
    word = ts.range_hashes(buf, starts, ends, eight)
    of = ts.of_docs(first)
    h = ts.Windows(word).of(3)
    inside = of[: len(h)] == of[2 : 2 + len(h)]
    at = np.flatnonzero(inside)
    long = ends - starts
    same_word = lambda i, j: (long[i] == long[j]) & ts.equal_ranges(buf, starts[i], starts[j], np.minimum(long[i], long[j]), eight)
    _, twice = _same_before(of[at], h[at], lambda i, j: same_word(at[i], at[j]) & same_word(at[i] + 1, at[j] + 1) & same_word(at[i] + 2, at[j] + 2))
    cover = np.zeros(len(word) + 1, np.int64)
    hit = at[twice]
    cover[hit] += 1
    np.subtract.at(cover, hit + 3, 1)
    covered = np.cumsum(cover)[:-1] > 0
    out["n_repeat_words"] = np.bincount(of[covered], minlength=n)
    return out


def _ledger(batches):
    names = (*MEASURES, "n_lines")
    for batch in batches:
        got = {k: [] for k in names}
        for _, _, buf, offs in ts.scan(batch.column(1)):
            for k, v in measure(buf, offs).items():
                got[k].append(v)
        cols = [pa.array(np.concatenate(got[k]) if got[k] else np.empty(0), pa.int64()) for k in names]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["first", *names])


def failures() -> Column:
    """The failure bits, from the measurements."""
    bits = F.lit(0)
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the measurements, n_lines and `failed`, the bits of failed rules.

    No shuffle.  A null or empty text has no words, so its counts are 0 and the rule on few words
    fails.  Ids may be null or repeat, every input row gives one row; further columns of the input
    are not read, whatever their names.  Measurements cover whole texts of any length.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_ledger, f"doc_id long, {COLUMNS}").withColumn("failed", failures())


def verdict(ledger_df: DataFrame, policy: Policy | str = "v1") -> DataFrame:
    """Adds `kept` under a policy: no bit of its mask is set.  A null mask of failures stays null."""
    p = POLICIES[policy] if isinstance(policy, str) else policy
    return ledger_df.withColumn("kept", F.col("failed").bitwiseAND(F.lit(p.mask)) == 0)


def kept_rows(docs: DataFrame, policy: Policy | str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of a table, with all its columns, that a policy keeps."""
    prepare(docs.sparkSession)
    led = carried(docs, _ledger, COLUMNS, text_col).withColumn("failed", failures())
    return uncarried(verdict(led, policy).where("kept"), docs.columns)


def ablations(ledger_df: DataFrame, policy: Policy | str = "v1") -> DataFrame:
    """For each rule of a policy: rows failing it, rows that only it rejects, and rows kept without it.

    One aggregation over the ledger, by masks alone.  An empty ledger gives zeros.
    """
    p = POLICIES[policy] if isinstance(policy, str) else policy
    used = [r for r in RULES if p.mask >> r.bit & 1]
    one = ledger_df.agg(
        *(F.count_if(F.col("failed").bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"fail_{r.bit}") for r in used),
        *(F.count_if(F.col("failed").bitwiseAND(F.lit(p.mask)) == (1 << r.bit)).alias(f"only_{r.bit}") for r in used),
        F.count_if(F.col("failed").bitwiseAND(F.lit(p.mask)) == 0).alias("kept"),
    )
    return one.select(F.explode(F.array(*(F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), F.col(f"fail_{r.bit}").alias("n_failed"), F.col(f"only_{r.bit}").alias("n_only"), (F.col("kept") + F.col(f"only_{r.bit}")).alias("n_kept_without")) for r in used))).alias("x")).select("x.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = verdict(ledger(documents(spark, sf_dir)))
    base = POLICIES["base"].mask
    return led.select("doc_id", *MEASURES, (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", F.col("failed").cast("long").alias("failed_bits"))


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
c AS (
  SELECT doc_id, text, ws, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS k FROM g) WHERE k >= 2),
r AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (
    SELECT doc_id, i AS p FROM t UNION ALL SELECT doc_id, i + 1 FROM t UNION ALL SELECT doc_id, i + 2 FROM t) GROUP BY 1),
m AS (
  SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM c LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 32 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS failed_bits FROM f
"""
