"""Scalar functions: name -> least and most arguments, and a builder of native columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from plainsql.operators.semantics import Value, arithmetic, compare, double, text, whole
from plainsql.plans.parser import SqlError
from plainsql.sources.files import DELIMITERS, fields
from plainsql.sources.paths import json_values, xml_values

Built = Callable[..., Value]
REGISTRY: dict[str, tuple[int, int | None, Built]] = {}


def register(name: str, least: int, most: int | None, build: Built) -> None:
    """``most`` None: any number of arguments."""
    for n in name.split():
        REGISTRY[n] = (least, most, build)


def num(c: object) -> Value:
    return Value(c.cast("double"), "num")


def string(c: object) -> Value:
    return Value(c, "str")


def only_string(v: Value) -> object:
    return v.column if v.kind == "str" else F.lit(None).cast("string")


def _type(v: Value) -> Value:
    x = v.column
    if v.kind == "str":
        known = F.lit("str")
    elif v.kind == "none":
        return string(F.lit("none"))
    else:
        known = F.when(double(v) == F.floor(double(v)), "int").otherwise("num") if v.numeric else F.lit("str")
    return string(F.when(x.isNull(), "none").otherwise(known))


def _digits(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or math.isnan(v) else f"{v:.31g}")


def exact(v: Value) -> object:
    """Text of a value; of a number that is not whole, or too large for a bigint, its binary value in 31 digits. Spark's formats
    stop at the shortest digits that tell a double from others, so those go through a pandas UDF.
    """
    if v.kind != "num":
        return text(v)
    if v.literal is not None:
        return F.lit(f"{v.literal:.31g}")
    x = double(v)
    plain = (x == F.floor(x)) & (F.abs(x) < 9.2e18)
    return F.when(plain, whole(x).cast("string")).when(F.isnan(x), "NaN").otherwise(F.pandas_udf(_digits, "string")(F.when(~plain, x)))


def _delimited(line: Value, i: Value, delimiter: Value | None = None) -> Value:
    """The i-th field, from 1, of a line of delimited text. The delimiter must be one of those that files have."""
    given = "," if delimiter is None else delimiter.constant
    if given not in DELIMITERS or len(given or "") != 1:
        raise SqlError(f"no delimiter {given!r}")
    return string(F.get(fields(text(line), given), whole(double(i)).cast("int") - 1))


def _whole2(f: Callable) -> Built:
    return lambda a, b: num(f(whole(double(a)), whole(double(b))))


_BLANKS = " \t\n\r"
register("plus", 2, 2, lambda a, b: arithmetic("+", a, b))
register("add", 0, None, lambda *v: num(sum((F.coalesce(double(x), F.lit(0.0)) for x in v), F.lit(0.0))))
register("mod", 2, 2, _whole2(F.try_mod))
register("div", 2, 2, lambda a, b: num(F.when(whole(double(b)) != 0, F.call_function("div", whole(double(a)), F.when(whole(double(b)) != 0, whole(double(b)))))))
register("xor", 2, 2, _whole2(lambda a, b: a.bitwiseXOR(b)))
register("pow pw", 2, 2, lambda a, b: num(F.pow(double(a), double(b))))
register("ascii", 1, 1, lambda s: num(F.when(only_string(s) == "", 0).otherwise(F.conv(F.substring(F.hex(F.encode(only_string(s), "UTF-8")), 1, 2), 16, 10))))
register("char", 1, 1, lambda n: string(F.char(F.nullif(whole(double(n)), F.lit(0)))))
register("concat", 0, None, lambda *v: string(F.concat_ws("", *(exact(x) for x in v))))
register("concat_ws", 1, None, lambda s, *v: string(F.when(s.column.isNotNull(), F.call_function("concat_ws", text(s), *(text(x) for x in v)))))
register("left", 2, 2, lambda s, n: string(F.left(only_string(s), whole(double(n)).cast("int"))))
register("right", 2, 2, lambda s, n: string(F.right(only_string(s), whole(double(n)).cast("int"))))
register("lower", 1, 1, lambda s: string(F.lower(only_string(s))))
register("upper", 1, 1, lambda s: string(F.upper(only_string(s))))
register("length len", 1, 1, lambda s: num(F.octet_length(text(s))))
register("charindex", 2, 2, lambda s, sub: num(F.call_function("instr", text(s), text(sub))))
register("trim", 1, 1, lambda s: string(F.trim(text(s), F.lit(_BLANKS))))
register("ltrim", 1, 1, lambda s: string(F.ltrim(text(s), F.lit(_BLANKS))))
register("rtrim", 1, 1, lambda s: string(F.rtrim(text(s), F.lit(_BLANKS))))
register("str", 1, 1, lambda v: string(text(v)))
register("replace", 3, 3, lambda s, a, b: string(F.replace(text(s), text(a), text(b))))
register("replicate", 2, 2, lambda s, n: string(F.call_function("repeat", text(s), whole(double(n)).cast("int"))))
register("reverse", 1, 1, lambda s: string(F.reverse(text(s))))
register("substring", 3, 3, lambda s, i, n: string(F.call_function("substring", text(s), whole(double(i)).cast("int"), whole(double(n)).cast("int"))))
register("translate", 3, 3, lambda s, a, b: string(F.call_function("translate", text(s), text(a), text(b))))
register("soundex", 1, 1, lambda s: string(F.soundex(text(s))))
register("space", 1, 1, lambda n: string(F.call_function("repeat", F.lit(" "), whole(double(n)).cast("int"))))
register("unicode", 1, 1, lambda s: num(F.ascii(text(s))))
register("timestamp", 0, 0, lambda: string(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
register("type", 1, 1, _type)
register("like", 2, 2, lambda a, b: num(compare("like", a, b).cast("int")))
register("ilike", 2, 2, lambda a, b: num(compare("ilike", a, b).cast("int")))
for _name in "sqrt sin cos tan acos asin atan cbrt exp log10 log2 degrees radians abs ceil floor".split():
    register(_name, 1, 1, lambda x, f=getattr(F, _name): num(f(double(x))))
register("log ln", 1, 1, lambda x: num(F.ln(double(x))))
register("atan2", 2, 2, lambda a, b: num(F.atan2(double(a), double(b))))
register("sign", 1, 1, lambda x: num(F.signum(double(x))))
register("sqr", 1, 1, lambda x: num(double(x) * double(x)))
register("pi", 0, 0, lambda: num(F.lit(math.pi)))
SEED: dict[str, int] = {}


def _random(seed: Value | None = None) -> Value:
    """In [0, 1); by a literal seed, else by the one that srandom has set, else by chance."""
    given = SEED.get("last") if seed is None or seed.literal is None else int(seed.literal)
    return num(F.rand() if given is None else F.rand(given))


def _srandom(seed: Value) -> Value:
    """Sets the seed of the statements that follow; only a literal does."""
    if seed.literal is not None:
        SEED["last"] = int(seed.literal)
    return num(double(seed))


register("random", 0, 1, _random)
register("srandom", 1, 1, _srandom)
register("isnan", 1, 1, lambda x: num(F.isnan(double(x)).cast("int")))
register("isinf", 1, 1, lambda x: num((F.abs(double(x)) == float("inf")).cast("int")))
register("isfinite", 1, 1, lambda x: num((~F.isnan(double(x)) & (F.abs(double(x)) != float("inf"))).cast("int")))


def _all(found: object) -> Value:
    """Matches between commas; null if there is none."""
    return string(F.when(F.size(found) > 0, F.array_join(found, ",")))


register("csvfield from_csv", 2, 3, _delimited)
register("jsonpath get extract", 2, 2, lambda s, p: _all(json_values(text(s), text(p))))
register("xmlpath", 2, 2, lambda s, p: _all(xml_values(text(s), text(p))))
