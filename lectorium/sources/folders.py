"""The shared folder for what a job writes down on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be sent to all tasks; tables are counted before.
FEW = 200_000


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="lectorium-")
    return base


def materialised(df: DataFrame) -> DataFrame:
    """The table written down once, for plans that read it several times; survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as compressed columns, for tables of many short rows."""
    folder = f"{shared_base(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sent(df: DataFrame, few: int = FEW) -> DataFrame:
    """A table that is written down already, for a join: sent to all tasks if it has few rows."""
    return F.broadcast(df) if df.limit(few + 1).count() <= few else df
