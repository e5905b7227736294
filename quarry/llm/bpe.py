"""BPE encoding and decoding with forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can never be merged across, so a
text may be cut there, each fragment encoded on its own, and the results concatenated.  The pair
table comes from the vocabulary; cuts are marked on the whole batch with one table lookup per
byte, and only distinct fragments reach the tokenizer's model.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces as ps
from .tables import documents, prepare

DEFAULT_VOCABULARY = "word_bpe_49k.json"


class Codec:
    """Encodes batches of texts and decodes ids, for one vocabulary file."""

    def __init__(self, path: str):
        self.vocab = ps.vocabulary(path)
        self.joined = self.vocab.joined_pairs()
        text = {i: t for t, i in self.vocab.tokens.items()}
        text |= {i: t for t, i in self.vocab.special.items()}
        self.text = text
        self.byte_level = self.vocab.tokenizer.decoder is not None
        self.back = {c: b for b, c in enumerate(ps.byte_chars())}

    def _make(self, piece: bytes, flag: int) -> tuple[int, str, str]:
        """Number of ids of a fragment, the ids joined by one space, and the text they decode to."""
        ids = [self.vocab.special[piece.decode()]] if flag == 2 else [t.id for t in self.vocab.model_tokens(piece, flag == 1)]
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def batches(self, col: pa.Array):
        """(first document, one after the last, pieces, (number of ids, ids, decoded text) of each distinct piece)."""
        for i, j, step in ps.pieces(self.vocab, col, self.joined):
            yield i, j, step, self.vocab.lookup("codec", step.distinct, step.flags, self._make)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        out = [[] for _ in texts]
        for i, _, step, made in self.batches(pa.array(texts, pa.large_string())):
            for d, k in zip(step.doc.tolist(), step.of.tolist(), strict=True):
                out[i + d].extend(map(int, made[k][1].split()))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included.

        With a decoder in the vocabulary file, the bytes of all tokens together; without one, the
        tokens joined by one space.
        """
        if not self.byte_level:
            return " ".join(self.text[i] for i in ids if i in self.text)
        return b"".join(bytes(self.back[c] for c in self.text[i]) for i in ids if i in self.text).decode("utf-8", "replace")


def _digests(path: str):
    def run(batches):
        gc.disable()  # the tables hold no cycles, and walking them costs more than they do
        codec = Codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            n, ids, text = [], [], []
            for i, j, step, made in codec.batches(batch.column(1)):
                size = np.array([m[0] for m in made], np.int64)
                n += np.bincount(step.doc, weights=size[step.of], minlength=j - i).astype(np.int64).tolist() if made else [0] * (j - i)
                bounds = np.searchsorted(step.doc, np.arange(j - i + 1)).tolist()
                as_ids, as_text, of = [m[1] for m in made], [m[2] for m in made], step.of.tolist()
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    mine = of[a:b]
                    ids.append(sha(" ".join([as_ids[k] for k in mine])))
                    text.append(sha(" ".join([as_text[k] for k in mine])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoder(path: str):
    def run(batches):
        codec = Codec(path)
        for batch in batches:
            out = codec.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoder(path: str):
    def run(batches):
        codec = Codec(path)
        for batch in batches:
            out = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return run


def _columns(df: DataFrame, *pairs: tuple[str, str, str]) -> DataFrame:
    prepare(df.sparkSession)
    return df.select(*(F.col(c).cast(kind).alias(name) for c, kind, name in pairs))


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each row.  Null and empty texts have no ids; rows with equal ids each give a row; other columns are not read."""
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    return _columns(docs, (id_col, "long", "doc_id"), (text_col, "string", "text")).mapInArrow(_encoder(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids.  Null and empty ids give an empty text; ids outside the vocabulary are skipped, as the library does."""
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    return _columns(encoded, (id_col, "long", "doc_id"), (ids_col, "array<int>", "ids")).mapInArrow(_decoder(path), "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text, returning only digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    For vocabularies without a decoder, whose decoded text is the tokens joined by spaces, so that
    the digest can be taken fragment by fragment.  Null and empty texts give no ids and the digests
    of the empty string.  Rows with equal or null ids each give a row; other columns are not read.
    """
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    if ps.vocabulary(path).tokenizer.decoder is not None:
        raise ValueError("round_trip takes vocabularies without a decoder; use encode and decode")
    src = _columns(docs, (id_col, "long", "doc_id"), (text_col, "string", "text"))
    return src.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
