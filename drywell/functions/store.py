"""Cutting lineage: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Makes spark.checkpoint.dir the checkpoint folder; a temporary one only where none is set and Spark is local."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="drywell-")
        spark.conf.set("spark.checkpoint.dir", top)
    spark.sparkContext.setCheckpointDir(top)


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share."""
    ready(spark)
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Bytes of a row group: a table of any number of files is read by as many tasks as there are cores.
GROUP_BYTES = 8 << 20


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept as Parquet in the shared folder, so that what builds on it computes nothing again and reads only the columns and rows that it asks for."""
    path = fresh(df.sparkSession, "settled")
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
