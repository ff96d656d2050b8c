"""Tables of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbers(spark: SparkSession, low: float, high: float, step: float = 1.0) -> DataFrame:
    """Column i: low, low + step, ... up to high, both ends included; generated by tasks, not sent to them."""
    count = max(0, int((high - low) / step + 1e-9) + 1)
    return spark.range(count).select((F.lit(float(low)) + F.col("id") * F.lit(float(step))).alias("i"))


def correlated(df: DataFrame, low: Column, high: Column, step: Column, name: str) -> DataFrame:
    """df with a row for each number from low to high of each row."""
    n = F.floor((high - low) / step + 1e-9).cast("int")
    return df.withColumn("__k", F.explode(F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>")))).withColumn(name, low + F.col("__k") * step).drop("__k")
