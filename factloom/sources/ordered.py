"""A table's rows by their place in an order, however many they are: range partitions, sorted and written, with their counts before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def numbered(df: DataFrame, *order, number: str = "place") -> DataFrame:
    """The table with each row's place in the order, from 0. Rows that the order doesn't tell apart stand in any order.

    Each task sorts and writes a range; the driver gets one count for each task. The table that is written is where lineage ends."""
    spark, path = df.sparkSession, store.scratch(df.sparkSession, "ordered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    out = spark.read.parquet(path)
    part, begin, starts = F.shiftright("_at", 33), 0, []
    for r in out.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r["part"], begin))
        begin += r["n"]
    before = F.broadcast(spark.createDataFrame(starts, "_part long, _begin long"))
    return out.join(before, part == F.col("_part")).withColumn(number, F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_begin")


def median(df: DataFrame, value: str) -> DataFrame:
    """One row, one column, `median`: the exact median of a column's values that are not null, null where there are none. Only ranges are
    sorted; no buffer holds the values."""
    rows = numbered(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), "v")
    n = rows.agg(F.count("*").alias("n"))
    middle = (F.col("place") == F.floor((F.col("n") - 1) / 2)) | (F.col("place") == F.floor(F.col("n") / 2))
    return rows.join(F.broadcast(n)).where(middle).agg(F.avg("v").alias("median"))
