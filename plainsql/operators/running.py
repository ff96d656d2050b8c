"""Running aggregates in the order of the input, without gathering all rows in one task.

Rows lie in ordered segments. Each segment has its own running window; what the segments before it add up to is computed from
one row a segment and joined back. count, sum, sum of squares, min and max all merge, so the deviation does too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Plan nodes above which rows need not come in the same order each time they are computed.
MOVING = {"Join", "Aggregate", "Sort", "Window", "RepartitionByExpression", "Repartition", "RebalancePartitions", "GlobalLimit", "Deduplicate", "Sample"}


def settled(df: DataFrame) -> DataFrame:
    """df, stored if it stands above a shuffle or a join, as its rows are read twice and must come in the same order.

    In the folder that spark.checkpoint.dir names; only where it names none, beside the warehouse.
    """

    def moves(p: object) -> bool:
        below = p.children()
        return p.nodeName() in MOVING or any(moves(below.apply(i)) for i in range(below.size()))

    if not moves(df._jdf.queryExecution().optimizedPlan()):
        return df
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint()


def numbered(df: DataFrame, order: str | None = None, segments: int = 64) -> DataFrame:
    """df with __segment and __place: by the column ``order`` if given, else as rows come from the scan.

    Text is dealt to segments by its first bytes, which order it as far as they go.
    """
    if order is None:
        place = F.monotonically_increasing_id()
        return df.withColumn("__place", place).withColumn("__segment", F.shiftright("__place", 33))
    column = F.col(f"`{order}`")
    text = dict(df.dtypes)[order] == "string"
    key = (F.conv(F.substring(F.rpad(F.hex(F.encode(column, "UTF-8")), 12, "0"), 1, 12), 16, 10) if text else column).cast("double")
    cuts = df.select(F.percentile_approx(key, [i / segments for i in range(1, segments)], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    within = F.lit(0) if not cuts else F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + F.when(key > c, 1).otherwise(0))
    return df.withColumn("__place", F.col(f"`{order}`")).withColumn("__segment", F.coalesce(within, F.lit(0)).cast("bigint"))


def running(df: DataFrame, wanted: list[tuple[str, str, Column | None]]) -> DataFrame:
    """df (numbered) with a column for each (name, function, argument); functions: count, sum, min, max, avg, stdev.

    count without an argument numbers the rows. Sums of nothing are 0, min and max of nothing 0, as documented; avg of nothing
    and a deviation of one value are null.
    """
    parts: dict[str, tuple[Column, str]] = {}
    for name, f, x in wanted:
        v = F.lit(1) if x is None else x if f == "count" else x.cast("double")
        parts[f"{name}__n"] = (F.count(v), "sum")
        if f in ("sum", "avg", "stdev"):
            parts[f"{name}__s"] = (F.sum(v), "sum")
        if f == "stdev":
            parts[f"{name}__q"] = (F.sum(v * v), "sum")
        if f in ("min", "max"):
            parts[f"{name}__m"] = (F.min(v) if f == "min" else F.max(v), f)
    before = Window.orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("__segment").agg(*(c.alias(k) for k, (c, _) in parts.items()))
    offsets = totals.select("__segment", *(getattr(F, how)(k).over(before).alias(f"{k}0") for k, (_, how) in parts.items()))
    own = Window.partitionBy("__segment").orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row a segment: at most as many as the scan has partitions or ``segments`` says.
    here = df.withColumns({k: c.over(own) for k, (c, _) in parts.items()}).join(F.broadcast(offsets), "__segment")
    merge = {"sum": lambda k: F.coalesce(F.col(k), F.lit(0)) + F.coalesce(F.col(f"{k}0"), F.lit(0)), "min": lambda k: F.least(k, f"{k}0"), "max": lambda k: F.greatest(k, f"{k}0")}
    part = lambda name, p: merge[parts[f"{name}__{p}"][1]](f"{name}__{p}")
    out = {}
    for name, f, _ in wanted:
        n = part(name, "n")
        if f == "count":
            out[name] = n.cast("double")
        elif f == "sum":
            out[name] = part(name, "s")
        elif f in ("min", "max"):
            out[name] = F.coalesce(part(name, "m"), F.lit(0.0))
        elif f == "avg":
            out[name] = F.try_divide(part(name, "s"), n)
        else:
            s, q = part(name, "s"), part(name, "q")
            out[name] = F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))
    return here.withColumns(out).drop(*parts, *(f"{k}0" for k in parts))
