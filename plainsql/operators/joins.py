"""Tolerant equality as a join key, and joins whose few keys have many pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsql.operators.semantics import Value, teq

#: Width of a bucket of logarithms: over twice what the tolerance spans.
WIDTH = 1e-8
#: Pairs of rows of equal keys from which a join is sliced, and those of one task; ranges that a column is sliced into at most.
MANY_PAIRS, TASK_PAIRS, SLICES = 50_000_000, 20_000_000, 64


def _bucket(x: Column) -> Column:
    return F.when(x == 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.ln(F.abs(x)) / WIDTH).cast("bigint") * 2 + F.when(x > 0, 1).otherwise(2).cast("bigint") * 10_000_000_000_000)


def tolerant_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on tolerantly equal doubles, as an equi-join on buckets of logarithms.

    Equal values lie in one bucket or in neighbours, so the right side is sent to three; a pair meets in one of them at most.
    Without it the predicate would be a disjunction, and the plan a nested loop.
    """
    x, y = F.col(f"`{left_key}`").cast("double"), F.col(f"`{right_key}`").cast("double")
    near = right.where(y.isNotNull()).withColumn("__near", F.explode(F.when(y == 0, F.array(_bucket(y))).otherwise(F.array(_bucket(y) - 2, _bucket(y), _bucket(y) + 2))))
    own = left.where(x.isNotNull()).withColumn("__own", _bucket(x))
    return own.join(near, (F.col("__own") == F.col("__near")) & teq(Value(x, "num"), Value(y, "num"))).drop("__own", "__near")


def sliced_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], x: str, y: str, less: bool) -> DataFrame:
    """Inner join on ``keys``, of rows that may have x < y (``less``) or x > y, or both equal: whole numbers, x on the left.

    Few keys with many pairs are few tasks, as shuffles are sized by their input. So the left side is sliced by ranges of x, and a
    right row goes to all slices that may have its partners; the others are never compared. A pair meets in one slice. Counts and
    ranges are found by a first pass; they only tell how rows are dealt out.
    """
    points = [k / SLICES for k in range(1, SLICES)]
    n, distinct, bounds = left.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*(F.col(a) for a, _ in keys))), F.percentile_approx(x, points)).first()
    pairs = n * right.count() // max(1, distinct)
    if pairs < MANY_PAIRS or not bounds:
        return left.join(right, [F.col(a) == F.col(b) for a, b in keys])
    parts = -(-pairs // TASK_PAIRS)
    wanted = min(SLICES, -(-8 * parts // distinct))
    bounds = sorted({bounds[k * SLICES // wanted - 1] for k in range(1, wanted)})
    place = lambda c: F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b <= F.col(c)))
    own = left.where(F.col(x).isNotNull()).withColumn("__own", place(x))
    all_ = F.sequence(F.lit(0), place(y)) if less else F.sequence(place(y), F.lit(len(bounds)))
    near = right.where(F.col(y).isNotNull()).withColumn("__near", F.explode(all_))
    own, near = own.repartition(parts, *(a for a, _ in keys), "__own"), near.repartition(parts, *(b for _, b in keys), "__near")
    return own.join(near, [*(F.col(a) == F.col(b) for a, b in keys), F.col("__own") == F.col("__near")]).drop("__own", "__near")
