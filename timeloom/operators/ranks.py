"""Places of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.storage import cut


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with `place`, from 0, in the order of some columns: ranges of rows are sorted each in its own task, and each begins where
    the counts of those before it end."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns: list[Column] = [F.col(c) for c in order]
    ranged = cut(rows.repartitionByRange(parts, *columns).withColumn("_part", F.spark_partition_id()))
    before, starts = 0, []
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():  # a row for each partition
        starts.append((r["_part"], before))
        before += r["count"]
    first = spark.createDataFrame(starts, "_part int, _before bigint")
    mine = F.row_number().over(Window.partitionBy("_part").orderBy(*columns)) - 1
    return ranged.withColumn("_k", mine).join(F.broadcast(first), "_part").withColumn("place", F.col("_before") + F.col("_k")).drop("_part", "_before", "_k")
