"""Writing results: JSON lines, Parquet stages keyed by their settings, metric files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """One row as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_evaluation(results: DataFrame, metrics: dict[str, DataFrame], config: dict, folder: str) -> None:
    """An evaluation as `results` in Parquet and `summary`, one JSON line: the settings, and one row of each named table.

    The summary comes last, so a folder with one is whole; before the results are replaced, the old summary goes.
    """
    spark = results.sparkSession
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/summary")
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    rows = {name: df.first().asDict(recursive=True) for name, df in metrics.items()}  # means: one row each
    results.write.mode("overwrite").parquet(f"{folder}/results")
    line = json.dumps({"config": config, **rows}, sort_keys=True, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")


def read_evaluation(spark: SparkSession, folder: str) -> tuple[DataFrame, dict] | None:
    """Results and summary of an evaluation that was written to its end, or nothing."""
    if not complete(spark, f"{folder}/summary"):
        return None
    return spark.read.parquet(f"{folder}/results"), json.loads(spark.read.text(f"{folder}/summary").first()[0])


def config_key(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def fingerprint(*inputs: DataFrame) -> list[str]:
    """Row count and an order-free checksum of each input; one aggregation each, a few bytes reach the driver."""
    out = []
    for df in inputs:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")).alias("s")).first()
        out.append(f"{','.join(df.columns)}:{r['n']}:{r['s']}")
    return out


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def stage(spark: SparkSession, folder: str, name: str, config: dict, build: Callable[[], DataFrame], use_cache: bool = True) -> DataFrame:
    """Reads a stage that was written whole under the same settings, or builds and writes it.

    `config` has to name everything that the rows depend on; `fingerprint` gives that of inputs.
    """
    path = f"{folder}/{name}-{config_key(config)}"
    if not (use_cache and complete(spark, path)):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """The table of judgements, or an empty one."""
    kind = "entity_class string, range_class string, relation string, score double"
    try:
        return spark.read.schema(kind).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], kind)


def append_judgements(new: DataFrame, path: str) -> None:
    new.select("entity_class", "range_class", "relation", "score").write.mode("append").parquet(path)
