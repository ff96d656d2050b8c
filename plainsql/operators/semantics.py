"""Comparison and arithmetic of the dialect as native columns, with the kind of each value known at plan time."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Value(NamedTuple):
    """kind: num (double), int (integral column), str, bool, none (null literal), any (other types, as they are)."""

    column: Column
    kind: str
    #: The number, if it is a literal.
    literal: float | None = None
    #: The text, if it is a literal.
    constant: str | None = None

    @property
    def numeric(self) -> bool:
        return self.kind in ("num", "int")


TOLERANCE = 1e-9


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "num"
    return {"StringType": "str", "BooleanType": "bool", "NullType": "none"}.get(type(t).__name__, "any")


def double(v: Value) -> Column:
    """As a number; text that is none is null."""
    return v.column.try_cast("double") if v.kind == "str" else v.column.cast("double")


def teq(a: Value, b: Value) -> Column:
    """Tolerant equality; of two integral columns exact, so it can be a join key."""
    if a.kind == b.kind == "int":
        return a.column == b.column
    x, y = double(a), double(b)
    if b.literal is not None:  # bounds that a scan can check
        c, d = b.literal, 3 * TOLERANCE * abs(b.literal)
        return (a.column >= c - d) & (a.column <= c + d) & ((x == y) | (F.abs(x - y) < TOLERANCE * (F.abs(x) + F.abs(y))))
    return (x == y) | (F.abs(x - y) < TOLERANCE * (F.abs(x) + F.abs(y)))


def glob(pattern: str) -> str:
    """% and * stand for any run, _ and ? for one character; nothing escapes."""
    return "^" + "".join(".*" if c in "%*" else "." if c in "_?" else re.escape(c) for c in pattern) + "$"


def compare(op: str, a: Value, b: Value, pattern: str | None = None, keep_null: bool = False) -> Column:
    """Two-valued: a null operand, or a string against a number, is false. ``keep_null`` leaves nulls where the caller takes
    them for false anyway, as a filter does; then a scan can check the comparison.
    """
    if a.kind == "none" or b.kind == "none":
        return F.lit(False)
    if op in ("like", "ilike"):
        x, pattern = a.column.cast("string"), b.constant if pattern is None else pattern
        if pattern is not None:
            found = x.rlike(("(?is)" if op == "ilike" else "(?s)") + glob(pattern))
        else:
            found = F.call_function(op, x, F.replace(F.translate(b.column.cast("string"), "*?", "%_"), F.lit("\\"), F.lit("\\\\")))
        return found if keep_null else F.coalesce(found, F.lit(False))
    if a.numeric and b.numeric:
        same, less = teq(a, b), a.column < b.column
        exact = a.column == b.column
    elif a.numeric != b.numeric and "str" in (a.kind, b.kind):
        return F.lit(False)
    else:
        same = exact = F.lower(a.column) == F.lower(b.column) if op == "~=" else a.column == b.column
        less = a.column < b.column
    made = {
        "=": same, "~=": same, "==": exact, "!=": ~same, "<>": ~same, "<": less & ~same, "<=": less | same, "!>": less | same,
        ">": ~less & ~same, ">=": ~less | same, "=>": ~less | same, "!<": ~less | same,
    }[op]
    return made if keep_null else F.coalesce(made, F.lit(False))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """A left string stays as it is; a right string counts as 0. Division by zero gives null."""
    if "none" in (a.kind, b.kind):
        return Value(F.lit(None).cast("double"), "num")
    if a.kind == "str":
        return Value(F.when(b.column.isNotNull(), a.column), "str")
    x, y = double(a), F.when(b.column.isNotNull(), F.lit(0.0)) if b.kind == "str" else double(b)
    if op == "/":
        return Value(F.try_divide(x, y), "num")
    if op == "%":
        return Value(F.try_mod(whole(x), whole(y)).cast("double"), "num")
    if op == "&":
        return Value(whole(x).bitwiseAND(whole(y)).cast("double"), "num")
    if op == "|":
        return Value(whole(x).bitwiseOR(whole(y)).cast("double"), "num")
    return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "^": lambda: F.pow(x, y)}[op](), "num")


def whole(x: Column) -> Column:
    """Truncated to a bigint; null where it doesn't fit."""
    return F.when(F.abs(x) < 9.2e18, x.cast("bigint"))


def text(v: Value) -> Column:
    """A whole number without a fraction, anything else as Spark writes it."""
    if v.kind == "num":
        x = v.column.cast("double")
        return F.when((x == F.floor(x)) & (F.abs(x) < 9.2e18), whole(x).cast("string")).otherwise(x.cast("string"))
    return v.column.cast("string")
