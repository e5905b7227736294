"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter trigram is bound as the product of its
letters' vectors, each permuted (rotated) by its place; a text is the bundle (sum) of its
trigrams, a language the bundle of its training texts.  Texts and languages are compared by cosine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .tables import carried, documents, held_out, prepare, uncarried

#: Symbols of the n-gram alphabet: 0 for a break between words, a to z, and buckets for other letters.
SYMBOLS = 64
#: Length of the vectors.
DIMENSIONS = 512
#: Texts per language from which profiles are learnt, those with the smallest hash of their ids.
TRAIN_PER_LANGUAGE = 1500
#: Bytes of text scanned at a time; the table of trigram vectors that are present stays small.
STEP = 1 << 20
UNDETERMINED = "und"
#: A text that is less like every language than this is rejected where languages are required, however short.
LEAST_SCORE = 0.01
#: A text of so many letters is long enough to be judged by its score; letter junk and texts in other languages score
#: below this quantile of such learning texts.
ENOUGH_LETTERS, LOW_QUANTILE = 40, 0.002
#: The best chance cosine stays below four deviations; no bound is lower.
CHANCE = 4 / DIMENSIONS**0.5


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Code point to symbol: letters are lower-cased first, anything else is a break."""
    out = np.zeros(0x110000, np.uint8)
    for p in [*range(0xD800), *range(0xE000, 0x110000)]:
        c = chr(p)
        if c.isalpha():
            q = ord(c.lower()[0])
            out[p] = q - 96 if 97 <= q <= 122 else 27 + q * 7 % (SYMBOLS - 27)
    return out


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    """One row of +1 and -1 per symbol, the same in every process."""
    return np.random.default_rng(20240607).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Binding: the product of three letter vectors, rotated by 2, 1 and 0 places."""
    v = letter_vectors()
    a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return (np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]).astype(np.float32)


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and how many letters it has."""
    n = len(texts)
    points = np.frombuffer("\n".join(["", *(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)]) + 1  # each text follows a line feed
    sym = symbol_table()[points]
    letters = np.diff(np.concatenate([[0], np.cumsum(sym > 0)])[first])
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0)  # several breaks count as one
    at = np.flatnonzero(keep)
    s = sym[at].astype(np.int32)
    if len(s) < 3:
        return np.zeros((n, DIMENSIONS), np.float32), letters
    code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    mid = at[1:-1]
    ok = s[1:-1] > 0
    code, doc = code[ok], np.searchsorted(first, mid[ok], side="right") - 1
    present = np.bincount(code, minlength=SYMBOLS**3) > 0
    columns = np.flatnonzero(present)
    index = np.cumsum(present) - 1
    counts = np.bincount(doc * len(columns) + index[code], minlength=n * len(columns)).reshape(n, -1).astype(np.float32)
    return counts @ trigram_vectors(columns), letters


def _steps(col: pa.Array):
    _, offs = ts.text_buffer(col)
    for i, j in ts.steps(offs, STEP):
        for k in range(i, j, 512):
            yield k, min(j, k + 512), col.slice(k, min(j, k + 512) - k).to_pylist()


def _learn(batches):
    """Partial bundles of unit vectors by language."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = batch.column(0).to_pylist()
        for i, j, texts in _steps(batch.column(1)):
            v, _ = bundles(texts)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
            for name in set(lang[i:j]):
                mine = np.array([x == name for x in lang[i:j]])
                sums[name] = sums.get(name, 0) + v[mine].sum(axis=0, dtype=np.float64)
    names = list(sums)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[k].tolist() for k in names], pa.list_(pa.float64()))], names=["lang", "vec"])


@dataclass(frozen=True)
class Profiles:
    """Languages and their unit prototype vectors."""

    names: list[str]
    vectors: np.ndarray


def fit(labelled: DataFrame, per_language: int | None = TRAIN_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Learns one prototype per language from rows with a language, at most `per_language` texts each, or from all with None.

    The sample is bounded by that parameter: the rows with the smallest hash of their ids.  It is
    chosen without reading texts.  Rows with a null language or id are not learnt from; an empty
    table gives no language.
    """
    parts = _sample(labelled, per_language, id_col, text_col, lang_col).mapInArrow(_learn, "lang string, vec array<double>")
    sums = parts.select("lang", F.posexplode("vec")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).collect()  # DIMENSIONS rows a language
    names = sorted({r["lang"] for r in sums})
    v = np.zeros((len(names), DIMENSIONS))
    for r in sums:
        v[names.index(r["lang"]), r["pos"]] = r["x"]
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return Profiles(names, np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32))


def _sample(labelled: DataFrame, per_language: int | None, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(l, t): language and text of the rows that are learnt from."""
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).cast("long").alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")).where("i is not null and l is not null")
    if per_language is None:
        return rows.select("l", "t")
    # a draw from the id; the cut, by a table of one row a language, leaves about three times the sample of each language to be ranked, however many rows there are
    drawn = rows.select("i", "l", F.pmod(F.xxhash64("i"), F.lit(1 << 40)).alias("draw"))
    share = drawn.groupBy("l").agg(F.least(F.lit(1.0), F.lit(3.0 * per_language) / F.count("*")).alias("share"))
    drawn = drawn.join(F.broadcast(share), "l").where(F.col("draw") <= F.col("share") * (1 << 40))
    order = Window.partitionBy("l").orderBy("draw", "i")
    chosen = drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select(F.col("i").alias("j"), F.col("l").alias("m")).distinct()
    # at most per_language rows for each language: of a size that is bounded by the parameter
    return rows.join(F.broadcast(chosen), (F.col("i") == F.col("j")) & (F.col("l") == F.col("m")), "left_semi").select("l", "t")


#: Bins of scores between 0 and 1 that are counted to find a quantile.
BINS = 1 << 16


def least_score(labelled: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The score below which a text of ENOUGH_LETTERS is in no learnt language: LOW_QUANTILE of all rows with a language and an id, CHANCE at least.

    Every such row is scored once and counted in its bin of scores; the bound is the lower end of the
    bin that holds the quantile, so at most that share of them is below it.  Fewer than
    1 / LOW_QUANTILE rows do not tell that quantile; the bound then is CHANCE.
    """
    prepare(labelled.sparkSession)
    texts = labelled.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))
    said = texts.mapInArrow(_predict(profiles, letters=True), "first string, lang_pred string, score double, letters long").where(F.col("letters") >= ENOUGH_LETTERS)
    counts = said.groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()  # BINS rows at most
    total = sum(x["n"] for x in counts)
    if total * LOW_QUANTILE < 1:
        return CHANCE
    below = 0
    for x in sorted(counts, key=lambda x: x["bin"]):
        below += x["n"]
        if below > (total - 1) * LOW_QUANTILE:
            return max(x["bin"] / BINS, CHANCE)
    return CHANCE


def classify(texts: list[str | None], profiles: Profiles) -> tuple[list[str], list[float]]:
    """The nearest language of each text and its cosine, cut to 0 at least."""
    return _classify(texts, profiles)[:2]


def _classify(texts: list[str | None], profiles: Profiles) -> tuple[list[str], list[float], list[int]]:
    """What `classify` gives, and how many letters each text has."""
    v, letters = bundles(texts)
    if not profiles.names:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts), letters.tolist()
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0) @ profiles.vectors.T
    best = np.argmax(cos, axis=1)
    score = np.clip(cos[np.arange(len(texts)), best].astype(np.float64), 0.0, 1.0)
    return [profiles.names[b] if n else UNDETERMINED for b, n in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters > 0, score, 0.0).tolist(), letters.tolist()


def _predict(profiles: Profiles, letters: bool = False):
    def run(batches):
        for batch in batches:
            names, scores, sizes = [], [], []
            for _, _, texts in _steps(batch.column(1)):
                a, b, n = _classify(texts, profiles)
                names += a
                scores += b
                sizes += n
            out = {"first": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_pydict(out | ({"letters": pa.array(sizes, pa.int64())} if letters else {}))

    return run


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each row, from whole texts.

    A text that is null or has no letter, and any text when no language was learnt, is `und` with
    score 0.  Ties go to the language that sorts first.  Rows with equal or null ids each give a
    row; other columns are not read.  The profiles travel with the tasks: one vector per language.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_predict(profiles), "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, profiles: Profiles, least: float = LEAST_SCORE, text_col: str = "text", bound: float = CHANCE) -> DataFrame:
    """The rows of a table, with all its columns, whose text has a language: not `und`, and a score of at least `least`.

    A text of ENOUGH_LETTERS needs a score of `bound`; the score of a shorter one says too little to reject it.
    """
    prepare(docs.sparkSession)
    said = carried(docs, _predict(profiles, letters=True), "lang_pred string, score double, letters long", text_col)
    need = F.when(F.col("letters") >= ENOUGH_LETTERS, F.greatest(F.lit(least), F.lit(bound))).otherwise(F.lit(least))
    return uncarried(said.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= need)), docs.columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = fit(documents(spark, sf_dir, "doc_id", "text", "lang").where(~held_out()))
    return identify(documents(spark, sf_dir), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
