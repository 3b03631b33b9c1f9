"""Tables that a plan writes on its way and reads again: they cut lineage and are computed once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What driver and executors share: ``spark.checkpoint.dir``; only on one machine, where that is unset, a folder of the
    session's warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


FEW_ROWS = 4


def keep(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """The same rows, written and read back; ``large`` ones, of megabytes each, are buffered and read a few at a time."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write = df.write.option("parquet.block.row.count.limit", str(FEW_ROWS)) if large else df.write
    write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes kept tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
