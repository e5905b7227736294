"""Reading inputs, cutting lineage in the shared folder, and session settings."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; documents can be long, so batches stay small.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Keeps Arrow batches small and gives tests a checkpoint folder where the cluster names none."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared(spark)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset, as in tests on one machine, a temporary folder is named instead.
    """
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have


def written(df: DataFrame, name: str, path: str | None = None) -> str:
    """Writes a DataFrame to the shared folder, or adds it to the table at `path`; returns the path."""
    path = path or f"{shared(df.sparkSession).rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return path


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes a DataFrame to the shared folder as Parquet and reads it back.

    The copy outlives executors, and what was shuffled before it can be removed at once.
    """
    spark = df.sparkSession
    path = written(df, name)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes the files behind a table that `cut` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quarry/" in file:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def held_out(doc_id="doc_id"):
    """crc32 of the decimal id, modulo 3, is 1."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3) == 1


def carried(docs: DataFrame, run, added: str, text_col: str = "text") -> DataFrame:
    """`row`, a struct of all columns of a table, and the columns that `run` adds to each row, without a join.

    run: a mapInArrow function over (any first column, text) that gives the first column back.  The
    table's own columns stay inside `row`, so names never clash.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    src = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, {added}")


def uncarried(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of `row` again."""
    return df.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))
