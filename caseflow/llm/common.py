"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import discard, shared_dir, ship

__all__ = ["BATCH_ROWS", "WORD", "discard", "held_out", "shared_dir", "short_batches", "stored", "table", "tokenizer_path"]

#: A word is a maximal run of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows a batch that goes to a Python worker; texts are long, so batches are short.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of texts holds in a Python worker, and lets workers import this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """The rows of df, written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, parts: int, part: int = 2) -> Column:
    """Whether crc32 of doc_id, as text, leaves the remainder `part`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def tokenizer_path(name: str) -> str:
    """A vocabulary file; CASEFLOW_TOKENIZERS names another folder than the installed one."""
    folder = os.environ.get("CASEFLOW_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
