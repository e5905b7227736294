"""The corpus pipeline: language, quality, near-duplicates, repeated passages, packing.

Each stage works on everything that its predecessor kept and returns the columns of `documents`;
the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, minhash, packing, quality, suffix
from quarry.llm.tables import cut, held_out, prepare

#: Words of a passage that is removed where it repeats, of however few bytes; 400 bytes in fewer words count as one too.
PASSAGE_WORDS = 50


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in a learnt language; texts that are null, without letters or like no language go."""
    learnt = docs.where(~held_out())
    profiles = langid.fit(learnt, per_language=None)
    return langid.recognised(docs, profiles, bound=langid.least_score(learnt, profiles))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass every rule of the current policy."""
    return quality.kept_rows(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five words, a similarity of 0.8 or more."""
    groups = minhash.near_duplicates(docs, percent=80)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 50 words, and strings of 400 bytes, that occur anywhere else."""
    return suffix.deduplicated(docs, words=PASSAGE_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens; one row per piece."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("language_id", language),
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", packed),
]

#: SQL can express neither the language profiles nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the table `documents`."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
