"""Aggregates over an unbounded stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsql.functions.aggregates import final


def aggregated(stream: DataFrame, wanted: list[tuple[str, str, str | None]], keys: list[str] | None = None, time: str | None = None, window: str | None = None, late: str | None = None) -> DataFrame:
    """A column for each (name, function, column), by keys and, if named, by windows over the column ``time``.

    ``late`` bounds how late rows may come and so how much state is kept.
    """
    if time and late:
        stream = stream.withWatermark(time, late)
    by = [*(keys or []), *([F.window(time, window)] if time and window else [])]
    return stream.groupBy(*by).agg(*(final(f, None if c is None else F.col(c)).alias(n) for n, f, c in wanted))
