"""Session helpers shared by every operator: where lineage is cut and how."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where it is unset, a folder that was set on
    the context counts; else a local master (tests) gets a temporary folder and any other master
    a folder of the warehouse, which all executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if spark.sparkContext.master.startswith("local"):
        return f"{tempfile.gettempdir()}/checkpoints"
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read that, which cuts its lineage.

    The rows are computed once (``DataFrame.checkpoint`` computes its last stage twice), later
    steps read only the columns they need, and nothing of the plan's constraints and
    partitionings is passed on: over joins of operators that are built on each other those
    multiply until planning takes longer than running.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame) -> DataFrame:
    """``df`` with new column identities, for a join or cogroup with a table of the same origin."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))
