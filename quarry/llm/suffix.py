"""Suffix-array deduplication by a depth-limited radix sort over bytes.

Suffixes are ordered only through the threshold, by passes over digits from the most significant
one; groups of one are dropped after each pass, and what is equal after the last are exactly the
repeated windows (`spans.sorted_windows`).  Before that, suffixes that cannot repeat are left out: a
row per suffix would move 16 times the input, so neighbours that share their smallest 256-byte gram
stand together, and only those whose gram occurs in another text around it are sorted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from . import textscan as ts
from .tables import cut, documents, prepare

WINDOW = 400
#: Bytes of the first digit; a stretch then has at most 145 windows.
GRAM = 256


def shape(window: int = WINDOW) -> spans.Shape:
    return spans.Shape("byte", window, max(1, window - 144))


def word_shape(words: int) -> spans.Shape:
    return spans.Shape("word", words, max(1, words * 16 // 25))


def _word_bytes(buf: np.ndarray, offs: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The bytes of the words that go, and what lies between two of them in a text."""
    if not len(gone):
        return np.zeros(len(buf), bool)
    starts, ends, first = ts.words(buf, offs)
    of = ts.of_docs(first)
    next_too = gone[:-1] & gone[1:] & (of[:-1] == of[1:])
    ends = ends.copy()
    ends[:-1][next_too] = starts[1:][next_too]
    step = np.bincount(starts[gone], minlength=len(buf) + 1) - np.bincount(ends[gone], minlength=len(buf) + 1)
    return np.cumsum(step)[:-1] > 0


def _per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])


def _remove(sh: spans.Shape, by_words: spans.Shape | None, cut_words: bool, as_text: bool):
    """cut_words: strings of words go as well; otherwise they are counted only."""

    def run(batches):
        for batch in batches:
            n_bytes, n_removed, n_spans, n_passage, digest, text = [], [], [], [], [], []
            for buf, offs, found in spans.marked(batch, *([sh, by_words] if by_words else [sh])):
                gone = found[0][1]
                both = gone | _word_bytes(buf, offs, found[1][1]) if by_words else gone
                n_passage += _per_text(both, offs).tolist()
                if cut_words:
                    gone = both
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = offs[:-1][offs[:-1] < offs[1:]]
                begins[heads] = gone[heads]
                n_bytes += np.diff(offs).tolist()
                n_removed += _per_text(gone, offs).tolist()
                n_spans += _per_text(begins, offs).tolist()
                raw = buf[~gone].tobytes()
                at = (offs - np.concatenate([[0], np.cumsum(gone)])[offs]).tolist()
                for a, b in zip(at[:-1], at[1:], strict=True):
                    digest.append(hashlib.sha256(raw[a:b]).hexdigest())
                    # a cut may fall inside a character; what is left of it is not text
                    text.append(raw[a:b].decode("utf-8", "ignore") if as_text else None)
            sums = [pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans, n_passage)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums, pa.array(digest, pa.string()), pa.array(text, pa.string())], names=["lead", *COUNTS, "kept_sha256", "kept"])

    return run


COUNTS = ("n_bytes", "n_removed", "n_spans", "n_passage_bytes")
RESULT = ", ".join([*(f"{c} long" for c in COUNTS), "kept_sha256 string", "kept string"])


def _runs(texts: DataFrame, sh: spans.Shape, name: str) -> DataFrame:
    """Confirmed runs of repeated windows."""
    return spans.confirmed(texts, sh, cut(spans.glued(spans.repeated(texts, sh, ordered=False)), name))


def _scored(docs: DataFrame, lead, text_col: str, window: int, words: int | None, cut_words: bool, as_text: bool) -> DataFrame:
    """(lead, what `_remove` counts) of each row; rows are texts of their own, whatever their ids."""
    prepare(docs.sparkSession)
    src = docs.select(F.monotonically_increasing_id().alias("d"), F.col(text_col).cast("string").alias("text"), lead.alias("lead"))
    known, sh, by_words = spans.stored(src), shape(window), word_shape(words) if words else None
    texts = known.select("d", "text")
    got = spans.listed(known, _runs(texts, sh, "runs"), "at", "n", "g", how="left", lead=F.struct("d", "lead").alias("lead"))
    if by_words:
        more = spans.listed_rows(_runs(texts, by_words, "passages"), "at", "n", "g")
        empty = lambda c: F.coalesce(F.col(f"l.{c}"), F.array().cast(f"array<{'binary' if c == 'g' else 'long'}>")).alias(f"w_{c}")
        got = got.join(more, F.col("lead.d") == F.col("d"), "left").select("lead", "text", "at", "n", "g", *map(empty, ("at", "n", "g")))
    kind = got.schema["lead"].dataType.simpleString()
    return got.mapInArrow(_remove(sh, by_words, cut_words, as_text), f"lead {kind}, {RESULT}")


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """Removes bytes covered by a window of bytes that also starts anywhere else, in the same text or another.

    One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256,
    kept (null unless with_text) and n_passage_bytes, the bytes covered by such windows or, with
    `words`, by strings of so many words that also start anywhere else.  Those strings are counted,
    not removed.  Null and empty texts have no bytes.  Rows with equal or null ids are texts of
    their own, so a repeated row is removed where it is long enough.  Windows never cross texts and
    are judged on the input.  Other columns are not read.
    """
    out = _scored(docs, F.col(id_col).cast("long"), text_col, window, words, False, with_text)
    return out.select(F.col("lead.lead").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_passage_bytes")


def deduplicated(docs: DataFrame, window: int = WINDOW, text_col: str = "text", words: int | None = None) -> DataFrame:
    """All columns of a table, its texts without the bytes that `dedup` removes; n_chars, if there, counts what is left.

    With `words`, strings of so many words that start anywhere else go as well, however few bytes they have.  A character that a cut divides goes as a whole.  Every row stays, if need be with an empty text.
    """
    rest = [c for c in docs.columns if c != text_col]
    row = F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("_"))
    out = _scored(docs, row, text_col, window, words, True, True)
    cols = {c: F.col(f"lead.lead.`{c}`") for c in rest} | {text_col: F.col("kept")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*(cols[c].alias(c) for c in docs.columns))


#: Words of a passage that op7 counts besides, however few bytes it has.
PASSAGE_WORDS = 50


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), words=PASSAGE_WORDS).drop("kept")
