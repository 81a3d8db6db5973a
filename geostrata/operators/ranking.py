"""Global numbering without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.runtime import checkpoint


def numbered(df: DataFrame, order: list, out: str = "rn") -> DataFrame:
    """``df`` with ``out``, each row's number from 1 in the order of the columns ``order``.

    Rows are range-partitioned by the order and numbered inside each partition; only one count per
    partition is added up. The order must be total for the numbers to be reproducible.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))  # a row per partition
    return local.join(F.broadcast(before), "_part").withColumn(out, F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_part", "_local", "_before")
