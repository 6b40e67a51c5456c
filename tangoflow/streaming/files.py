"""What the streaming sinks share: folders per micro-batch that a retry
overwrites, and a ledger of committed versions.  Spark's readers and writers
only, so that it works on every file system and session kind."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_if_there(spark: SparkSession, path: str, schema: T.StructType | str, *parts: str) -> DataFrame:
    """The Parquet data below ``path`` (or its sub-folders ``parts``, with
    ``path`` as base of the partition columns); empty where there is none."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(*([f"{path}/{p}" for p in parts] or [path]))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        empty = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([], empty)


def publish(spark: SparkSession, ledger: str, number: int, **values: int) -> None:
    """One row in the ledger, written as one file: there whole or not at all."""
    columns = ", ".join(f"{k} long" for k in values)
    spark.createDataFrame([tuple(values.values())], columns).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/m={number}")


def latest(spark: SparkSession, ledger: str, columns: str, below: int | None = None):
    """The ledger's last row (a Row with ``m``), or None."""
    rows = read_if_there(spark, ledger, f"{columns}, m long")
    rows = rows if below is None else rows.where(F.col("m") < below)
    return rows.orderBy(F.col("m").desc()).first()


def retire(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Frees a folder that no committed version names any more: overwritten
    with no rows, through Spark's committer."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)
