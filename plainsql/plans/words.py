"""The pipeline notation: ``1 to 10 sqr lt 55``. Constants go before the word that takes them; each word takes the value so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsql.functions import scalars
from plainsql.operators.semantics import Value, arithmetic, compare
from plainsql.plans.parser import SqlError
from plainsql.sources.generators import numbers

COMPARISONS = {"lt": "<", "gt": ">", "le": "<=", "ge": ">=", "eq": "=", "ne": "!="} | {x: x for x in ("<", ">", "<=", ">=", "=", "!=")}


def pipeline(spark: SparkSession, text: str) -> DataFrame:
    """Column value. ``a to b`` generates numbers, a comparison filters, any other word is an operator or a function."""
    words, i, df = text.split(), 0, None

    def constant() -> Value | None:
        nonlocal i
        if i < len(words):
            try:
                x = float(words[i])
            except ValueError:
                return None
            i += 1
            return Value(F.lit(x), "num", x)
        return None

    start = constant()
    if start is None:
        raise SqlError("a pipeline starts with a number")
    if i < len(words) and words[i] in ("to", "i"):
        i += 1
        if (stop := constant()) is None:
            raise SqlError("to what?")
        df = numbers(spark, start.literal, stop.literal).toDF("value")
    else:
        df = spark.range(1).select(start.column.alias("value"))
    while i < len(words):
        word = words[i]
        i += 1
        args = []
        while (c := constant()) is not None:
            args.append(c)
        own = Value(F.col("value"), "num")
        if word in COMPARISONS:
            df = df.where(compare(COMPARISONS[word], own, *args))
        elif word in ("+", "-", "*", "/", "%", "^"):
            df = df.select(arithmetic(word, own, *args).column.alias("value"))
        elif word == "out":
            break
        elif word in scalars.REGISTRY:
            least, most, build = scalars.REGISTRY[word]
            if len(args) + 1 < least or most is not None and len(args) + 1 > most:
                raise SqlError(f"{word} takes {least} arguments, not {len(args) + 1}")
            df = df.select(build(own, *args).column.alias("value"))
        else:
            raise SqlError(f"no word {word}")
    return df
