"""Syntax tree -> DataFrame. Nothing is handed to Spark as text; Catalyst optimizes the columns and joins built here."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsql.functions import aggregates, scalars
from plainsql.operators.joins import sliced_join, tolerant_join
from plainsql.operators.running import numbered, running, settled
from plainsql.operators.semantics import Value, arithmetic, compare, double, kind_of
from plainsql.plans.parser import Select, Source, SqlError
from plainsql.sources.generators import correlated, numbers

if TYPE_CHECKING:
    from plainsql.engine import Engine


def walk(tree: object):
    if isinstance(tree, (tuple, list)):
        if isinstance(tree, tuple) and tree and isinstance(tree[0], str):
            yield tree
        for x in tree:
            yield from walk(x)


def is_aggregate(t: tuple) -> bool:
    return t[0] == "call" and t[1] in aggregates.NAMES or t == ("name", "$lineno")


class Planner:
    """Of one SELECT. ``scope`` has (qualifier, name, physical column, kind), the latest last."""

    def __init__(self, engine: Engine, select: Select) -> None:
        self.engine, self.select = engine, select
        self.scope: list[tuple[str, str, str, str]] = []
        self.aliases: dict[str, tuple] = {}
        self.hidden: set[str] = set()  # columns that grouping leaves no value of
        self.made: dict[str, Value] = {}  # aggregates and group keys that are columns by now

    # names and expressions

    def named(self, name: str) -> Value:
        if name in self.aliases:
            return self.value(self.aliases[name])
        qualifier, _, rest = name.rpartition(".")
        for q, n, physical, kind in reversed(self.scope):
            if n == name or (qualifier and n == rest and q == qualifier):
                return Value(F.col(physical), kind)
        if name in self.engine.variables:
            return self.engine.variables[name]
        if name in self.hidden or rest in self.hidden:
            raise SqlError(f"{name} is neither grouped by nor aggregated")
        return Value(F.lit(None).cast("string"), "none")

    def value(self, t: tuple) -> Value:
        if (key := repr(t)) in self.made:
            return self.made[key]
        kind = t[0]
        if kind == "num":
            whole = t[1] == int(t[1]) and abs(t[1]) < 5e8 if abs(t[1]) < 1e300 else False
            return Value(F.lit(int(t[1]) if whole else t[1]), "int" if whole else "num", t[1])
        if kind == "str":
            return Value(F.lit(t[1]), "str", constant=t[1])
        if kind == "nothing":
            return Value(F.lit(None).cast("string"), "none")
        if kind == "name":
            return self.named(t[1])
        if kind == "neg":
            v = self.value(t[1])
            return Value(-v.column, v.kind, None if v.literal is None else -v.literal) if v.numeric else arithmetic("-", Value(F.lit(0.0), "num"), v)
        if kind == "op":
            return arithmetic(t[1], self.value(t[2]), self.value(t[3]))
        if kind == "call":
            return self.call(t)
        return Value(self.truth(t), "bool")

    def call(self, t: tuple) -> Value:
        _, name, args = t
        if name in aggregates.NAMES:
            raise SqlError(f"{name}() cannot stand here")
        if name not in scalars.REGISTRY:
            raise SqlError(f"no function {name}")
        least, most, build = scalars.REGISTRY[name]
        if len(args) < least or most is not None and len(args) > most:
            raise SqlError(f"{name}() takes {least if least == most else f'{least} to {most}' if most is not None else f'at least {least}'} arguments, not {len(args)}")
        return build(*map(self.value, args))

    def truth(self, t: tuple, keep_null: bool = False) -> Column:
        kind = t[0]
        test = lambda op, a, b: compare(op, a, b, keep_null=keep_null)
        if kind == "and":
            return self.truth(t[1], keep_null) & self.truth(t[2], keep_null)
        if kind == "or":
            return self.truth(t[1], keep_null) | self.truth(t[2], keep_null)
        if kind == "not":
            return ~self.truth(t[1])
        if kind == "cmp":
            return compare(t[1], self.value(t[2]), self.value(t[3]), t[3][1] if t[3][0] == "str" else None, keep_null)
        if kind == "in":
            return self.any_of([test("=", self.value(t[1]), self.value(x)) for x in t[2]])
        if kind == "between":
            v = self.value(t[1])
            return test(">=", v, self.value(t[2])) & test("<=", v, self.value(t[3]))
        if kind == "null":
            return self.value(t[1]).column.isNull()
        v = self.value(t)
        return F.coalesce(v.column if v.kind == "bool" else double(v) != 0, F.lit(False))

    @staticmethod
    def any_of(parts: list[Column]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out

    # FROM

    def added(self, df: DataFrame, s: Source, i: int) -> DataFrame:
        names = [f"s{i}_{j}" for j in range(len(df.columns))]
        self.scope += [(s.alias, n, p, kind_of(f.dataType)) for n, p, f in zip(df.columns, names, df.schema.fields, strict=True)]
        return df.toDF(*names)

    def source(self, left: DataFrame | None, s: Source, i: int) -> DataFrame:
        before = len(self.scope)
        if s.kind == "generator":
            depends = any(t[0] == "name" and self.named(t[1]).kind != "none" and t[1] not in self.engine.variables for t in walk(tuple(s.args)))
            bounds = [self.value(a) for a in s.args]
            if depends and left is not None:
                low, high, step = *map(double, bounds[:2]), double(bounds[2]) if len(bounds) > 2 else F.lit(1.0)
                self.scope.append((s.name, s.alias, f"s{i}_0", "num"))
                return correlated(left, low, high, step, f"s{i}_0")
            fixed = [self.engine.constant(b) for b in bounds]
            df = numbers(self.engine.spark, *fixed).toDF(s.alias)
            right = self.added(df, Source("generator", s.name, alias=s.name), i)
        else:
            right = self.added(self.engine.table(s, [self.value(a) for a in s.args]), s, i)
        if left is None:
            return right
        old, new = self.scope[:before], self.scope[before:]
        if s.on:
            find = lambda scope: next((x for x in reversed(scope) if x[1] == s.on), None)
            a, b = find(old), find(new)
            if not a or not b:
                raise SqlError(f"no column {s.on} on both sides")
            if "num" in (a[3], b[3]) and {a[3], b[3]} <= {"num", "int"}:
                return tolerant_join(left, right, a[2], b[2])
            return left.join(right, F.col(a[2]) == F.col(b[2]))
        pairs = self.pairs(old, new)
        if (exact := self.exact(pairs)) and len(self.select.sources) == 2 and (bound := next(filter(None, (self.bound(c, old, new) for c in self.conjuncts(self.select.where))), None)):
            return sliced_join(left, right, [(a[2], b[2]) for a, b in exact], *bound)
        return self.joined(left, right, pairs)

    def pairs(self, old: list, new: list) -> list[tuple]:
        return [p for p in map(lambda c: self.join_keys(c, old, new), self.conjuncts(self.select.where)) if p]

    @staticmethod
    def exact(pairs: list[tuple]) -> list[tuple]:
        return [p for p in pairs if p[0][3] == p[1][3] != "num"]

    def joined(self, left: DataFrame, right: DataFrame, pairs: list[tuple]) -> DataFrame:
        """By the equalities of WHERE: all exact ones, else a tolerant one, else every pair of rows."""
        if exact := self.exact(pairs):
            return left.join(right, [F.col(a[2]) == F.col(b[2]) for a, b in exact])
        if pairs:
            return tolerant_join(left, right, pairs[0][0][2], pairs[0][1][2])
        return left.crossJoin(right)

    def from_(self) -> DataFrame | None:
        """The sources joined as they are written, or, where none depends on another, each next one by an equality if there is one."""
        sources = self.select.sources
        if len(sources) < 3 or any(s.on or s.kind == "generator" for s in sources):
            df = None
            for i, s in enumerate(sources):
                df = self.source(df, s, i)
            return df
        left = []
        for i, s in enumerate(sources):
            before = len(self.scope)
            left.append((self.source(None, s, i), self.scope[before:]))
        df, scope = left.pop(0)
        while left:
            found = [self.pairs(scope, new) for _, new in left]
            best = max(range(len(left)), key=lambda k: (bool(self.exact(found[k])), bool(found[k]), -k))
            right, new = left.pop(best)
            df, scope = self.joined(df, right, found[best]), [*scope, *new]
        return df

    def conjuncts(self, t: tuple | None) -> list[tuple]:
        return [] if t is None else [*self.conjuncts(t[1]), *self.conjuncts(t[2])] if t[0] == "and" else [t]

    def join_keys(self, t: tuple, old: list, new: list) -> tuple | None:
        if t[0] != "cmp" or t[1] != "=" or t[2][0] != "name" or t[3][0] != "name":
            return None

        def find(name: str) -> tuple | None:
            q, _, n = name.rpartition(".")
            return next((x for x in reversed(self.scope) if x[1] == name or q and x[1] == n and x[0] == q), None)

        a, b = find(t[2][1]), find(t[3][1])
        if not a or not b:
            return None
        a, b = (a, b) if a in old else (b, a)
        return (a, b) if a in old and b in new and ("num" in (a[3], b[3]) and {a[3], b[3]} <= {"num", "int"} or a[3] == b[3]) else None

    def bound(self, t: tuple, old: list, new: list) -> tuple[str, str, bool] | None:
        """The whole-numbered columns of both sides that a conjunct orders, and whether the first source's is the lesser one."""
        found = self.join_keys(("cmp", "=", *t[2:]), old, new) if t[0] == "cmp" and t[1] in ("<", "<=", ">", ">=") else None
        if not found or {found[0][3], found[1][3]} != {"int"}:
            return None
        first = self.join_keys(("cmp", "=", t[2], t[2]), old, old)
        return found[0][2], found[1][2], (t[1][0] == "<") == bool(first)

    # SELECT

    def items(self) -> list[tuple[tuple, str]]:
        out = []
        for it in self.select.items:
            if it[0] == "expr":
                out.append(it[1:])
            elif it[0] == "star":
                out += [(("physical", p, k), n) for _, n, p, k in self.scope]
            else:
                wanted = re.compile("".join(".*" if c in "%*" else "." if c in "_?" else re.escape(c) for c in it[1]))
                out += [(("physical", p, k), f"{q}.{n}") for q, n, p, k in self.scope if wanted.fullmatch(f"{q}.{n}")]
        return out

    def plan(self) -> DataFrame:
        s, df = self.select, self.from_()
        if df is None:
            df = self.engine.spark.range(1).select()
        items = self.items()
        for t, name in items:
            if t[0] != "physical":
                self.aliases.setdefault(name, t) if not any(x == ("name", name) for x in walk(t)) else None
        self.made |= {repr(("physical", p, k)): Value(F.col(p), k) for _, _, p, k in self.scope}
        if s.where is not None:
            df = df.where(self.truth(s.where, keep_null=True))
        expanded = [self.expand(t) for t, _ in items]
        order = [(self.expand(self.ordinal(e, items)), down) for e, down in s.order]
        having = self.expand(s.having) if s.having else None
        found = {repr(t): t for tree in (*expanded, *(e for e, _ in order), *([having] if having else [])) for t in walk(tree) if is_aggregate(t)}
        if s.group or found and (self.engine.aggregate == "final" and ("name", "$lineno") not in found.values()):
            df = self.grouped(df, [self.expand(self.ordinal(k, items)) for k in s.group], found)
        elif found:
            df = self.run(df, found)
        if having:
            df = df.where(self.truth(having, keep_null=True))
        if order:
            df = df.orderBy(*((self.value(e).column.desc_nulls_last() if down else self.value(e).column.asc_nulls_first()) for e, down in order))
        if s.limit is not None:
            df = df.limit(s.limit)
        return df.select(*(self.value(t).column.alias(name) for t, (_, name) in zip(expanded, items, strict=True)))

    def ordinal(self, e: tuple, items: list) -> tuple:
        if e[0] == "num":
            if not 1 <= int(e[1]) <= len(items):
                raise SqlError(f"no column {e[1]:g}")
            return items[int(e[1]) - 1][0]
        return e

    def expand(self, t: object, seen: tuple = ()) -> object:
        """Aliases of the select list put in where they are used."""
        if isinstance(t, tuple) and t[:1] == ("name",) and t[1] in self.aliases and t[1] not in seen:
            return self.expand(self.aliases[t[1]], (*seen, t[1]))
        if isinstance(t, tuple) and t and isinstance(t[0], str):
            return (t[0], *(self.expand(x, seen) if isinstance(x, (tuple, list)) else x for x in t[1:]))
        if isinstance(t, list):
            return [self.expand(x, seen) for x in t]
        return t

    def arguments(self, t: tuple) -> tuple[str, Value | None]:
        if t[0] == "name":
            return "count", None
        if len(t[2]) > 1 or not t[2] and not aggregates.NAMES[t[1]]:
            raise SqlError(f"{t[1]}() takes 1 argument, not {len(t[2])}")
        v = self.value(t[2][0]) if t[2] else None
        if v and t[1] != "count" and not v.numeric:
            v = Value(F.lit(None).cast("double"), "num")  # strings are no numbers
        return t[1], v

    def grouped(self, df: DataFrame, keys: list, found: dict) -> DataFrame:
        names = {repr(k): f"__k{i}" for i, k in enumerate(keys)}
        values = [self.value(k) for k in keys]
        aggs = []
        for i, (text, t) in enumerate(found.items()):
            name, v = self.arguments(t)
            aggs.append((text, aggregates.final(name, v and v.column).alias(f"__a{i}")))
        keyed = [v.column.alias(n) for v, n in zip(values, names.values(), strict=True)]
        df = df.groupBy(*keyed).agg(*(a for _, a in aggs)) if aggs else df.select(*keyed).distinct()
        if keys:
            self.hidden = {x for q, n, _, _ in self.scope for x in (n, f"{q}.{n}")}
        self.scope, self.aliases = [], {}
        self.made = {text: Value(F.col(n), v.kind) for (text, n), v in zip(names.items(), values, strict=True)}
        self.made |= {text: Value(F.col(f"__a{i}"), "num") for i, (text, _) in enumerate(aggs)}
        return df

    def run(self, df: DataFrame, found: dict) -> DataFrame:
        wanted = []
        for i, t in enumerate(found.values()):
            name, v = self.arguments(t)
            wanted.append((f"__a{i}", name, v and v.column))
        order = self.engine.order_by and next((p for _, n, p, _ in self.scope if n == self.engine.order_by), None)
        if self.engine.order_by and not order:
            raise SqlError(f"no column {self.engine.order_by} to order by")
        df = running(numbered(df if order else settled(df), order), wanted)
        self.made |= {text: Value(F.col(f"__a{i}"), "num") for i, text in enumerate(found)}
        return df
