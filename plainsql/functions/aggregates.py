"""Final forms of the aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names, and whether they may go without an argument.
NAMES = {"count": True, "sum": False, "min": False, "max": False, "avg": False, "stdev": False}


def final(name: str, x: Column | None) -> Column:
    """Sums, least and most of nothing are 0; the mean of nothing and the deviation of one value are null."""
    if name == "count":
        return (F.count(F.lit(1)) if x is None else F.count(x)).cast("double")
    v = x.cast("double")
    return {"sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)), "min": lambda: F.coalesce(F.min(v), F.lit(0.0)), "max": lambda: F.coalesce(F.max(v), F.lit(0.0)), "avg": lambda: F.avg(v), "stdev": lambda: F.stddev_samp(v)}[name]()


def appended(df: DataFrame, key: str, value: str, piece: int = 10_000) -> DataFrame:
    """Values of each key, put together: key, part (from 0), n, and the values in the order of the scan, ``piece`` at most a row.

    A key's values are cut into pieces before they are gathered, so a frequent key is no row of unbounded size and no task has all
    of it. The parts of a key stand in order; their n add up to its count. Nulls are values; a null key is a key.
    """
    place = F.monotonically_increasing_id()
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"), place.alias("place"), F.spark_partition_id().alias("segment"))
    nth = F.row_number().over(Window.partitionBy("key", "segment").orderBy("place")) - 1
    parts = rows.withColumn("block", F.floor(nth / piece)).groupBy("key", "segment", "block").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("place", "value"))).alias("x"))
    return parts.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("segment", "block")) - 1).cast("long").alias("part"), "n", F.col("x.value").alias("values"))


def profile(df: object, column: str, order: str) -> object:
    """One row: numbers, nulls, strings (that are no numbers), least, most, mean, the last number, and whether the column never falls or never rises in that order.

    Neighbours are compared within ordered segments, and the last value of each segment with the first of the next.
    """
    from plainsql.operators.running import numbered

    x = F.col(column).try_cast("double")
    rows = numbered(df.withColumn("__x", x), order)
    own = Window.partitionBy("__segment").orderBy("__place")
    steps = rows.withColumn("__d", F.col("__x") - F.lag("__x").over(own))
    parts = steps.groupBy("__segment").agg(
        F.count("__x").alias("n"), F.count_if(F.col(column).isNull()).alias("nulls"), F.count_if(F.col(column).isNotNull() & F.col("__x").isNull()).alias("strings"), F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.sum("__x").alias("s"),
        F.coalesce(F.bool_and(F.col("__d") >= 0), F.lit(True)).alias("up"), F.coalesce(F.bool_and(F.col("__d") <= 0), F.lit(True)).alias("down"),
        F.min_by("__x", "__place").alias("first"), F.max_by("__x", F.when(F.col("__x").isNotNull(), F.col("__place"))).alias("last"),
    )
    gap = F.col("first") - F.lag("last").over(Window.orderBy("__segment"))
    return parts.withColumn("gap", gap).agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("n_null"), F.sum("strings").alias("n_str"), F.max_by("last", F.when(F.col("last").isNotNull(), F.col("__segment"))).alias("last"), F.min("lo").alias("min"), F.max("hi").alias("max"), (F.sum("s") / F.sum("n")).alias("avg"),
        (F.bool_and("up") & F.coalesce(F.bool_and(F.col("gap") >= 0), F.lit(True))).alias("never_falls"), (F.bool_and("down") & F.coalesce(F.bool_and(F.col("gap") <= 0), F.lit(True))).alias("never_rises"),
    )
