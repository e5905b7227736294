"""Token counts without ids: pieces are counted once per distinct pre-token.

Each task splits its documents into pre-tokens on arrays, counts the pieces of every distinct
pre-token of a step once, joins those counts to the per-document pre-token frequencies and sums.
Only whole numbers leave the task; no id list is made and nothing is shuffled.
"""

from __future__ import annotations

import gc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces as ps
from .tables import documents, prepare

DEFAULT_VOCABULARY = "byte_bpe_50k.json"


def _counter(path: str):
    def run(batches):
        gc.disable()  # the tables hold no cycles, and walking them costs more than they do
        vocab = ps.vocabulary(path)
        count = lambda piece, flag: 1 if flag == 2 else len(vocab.model_tokens(piece))
        for batch in batches:
            col = batch.column(1)
            out = np.zeros(len(col), np.int64)
            for i, j, step in ps.pieces(vocab, col):
                each = np.array(vocab.lookup("count", step.distinct, step.flags, count), np.int64)
                # (document, distinct pre-token) frequencies times the pieces of that pre-token
                out[i:j] = np.bincount(step.doc, weights=each[step.of], minlength=j - i) if len(each) else 0
            size = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(out)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row; `vocabulary` is a path to a byte-level BPE file.

    Null and empty texts have 0 bytes and 0 tokens.  Rows with equal or null ids each give a row;
    other columns of the input are not read.  A text of any length is counted whole.
    """
    prepare(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(_counter(path), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
