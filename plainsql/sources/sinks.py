"""Results as text, and the query log."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsql.operators.semantics import Value, kind_of, text
from plainsql.plans.parser import SqlError

SEPARATORS = {"tab": "\t", "csv": ",", "bar": "|"}
#: Letters for powers of 1000, up and down.
LARGE, SMALL = " kMGTPEZY", " munpfazy"


def write_text(df: DataFrame, path: str, format: str = "tab") -> None:
    """One file for each task, with a header; nulls are empty, quotes doubled."""
    df.write.mode("overwrite").csv(path, sep=SEPARATORS[format], header=True, nullValue="", escape='"')


def lines(df: DataFrame, format: str) -> DataFrame:
    """Each row as a line of text, in one column that is named as the header line.

    Nulls are empty. csv: text with a quote, a comma, a backslash, the end of a line or blanks around it stands in quotes, which
    are doubled inside. tab and bar: what would part a field or a line is a blank.
    """
    if format.lower() not in SEPARATORS:
        raise SqlError(f"no format {format}")
    sep = SEPARATORS[format.lower()]

    def cell(c: object) -> object:
        if sep != ",":
            return F.regexp_replace(c, rf"[\n\r\\{sep}]", " ")
        quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(c.rlike(r"""["',\\\n\r]|^\s|\s$""") | c.isin("", "NULL", "null"), quoted).otherwise(c)

    columns = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    cells = [F.coalesce(cell(text(Value(F.col(f.name), kind_of(f.dataType)))), F.lit("")) for f in columns.schema.fields]
    return columns.select(F.concat_ws(sep, *cells).alias(sep.join(df.columns)))


def human(x: float | None, width: int = 7) -> str:
    """A number in ``width`` columns. Positive ones up to a million are plain; of the others, whole multiples of a power of 1024
    and numbers from 10,000 up or below 0.0001 get a letter.
    """
    if x is None:
        return "NULL"
    size = abs(x)
    if 1e-6 < x <= 1e6:
        return f"{x:{width}.{width}g}"
    if size > 1e30:
        return f"{x:{width}.2g}"
    binary = next((p for p in range(len(LARGE) - 1, 0, -1) if size >= 1024**p), 0)
    if binary and size > 1024**binary and x % 1024**binary == 0:
        return f"{f'{x / 1024**binary:.4g}{LARGE[binary]}i':>{width}}"
    power = 0
    while size > 10_000 and abs(x) > 1000 and power < len(LARGE) - 1:
        x, power = x / 1000, power + 1
    while 0 < size < 1e-4 and abs(x) < 1 and -power < len(SMALL) - 1:
        x, power = x * 1000, power - 1
    return f"{x:{width}.5g}" if not power else f"{f'{x:.4g}{(LARGE if power > 0 else SMALL)[abs(power)]}':>{width}}"


def short(s: str | None, width: int = 7) -> str:
    """Text cut to ``width`` columns; a star tells that there was more."""
    s = "NULL" if s is None else s
    return s if len(s) <= width else s[: width - 1] + "*"


def shown(df: DataFrame, format: str = "tab") -> Iterator[str]:
    """Lines for a reader, one at a time, two of a header first: numbers by ``human``, text cut by ``short`` but in the last column."""
    last, sep = len(df.columns) - 1, SEPARATORS[format]

    def cell(x: object, i: int) -> str:
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return human(float(x))
        x = "NULL" if x is None else str(x)
        return x if i == last else short(x)

    yield sep.join(n if len(n) <= 7 or i == last else n[:5] + ".." for i, n in enumerate(df.columns))
    yield "======= " * len(df.columns)
    yield from (sep.join(cell(x, i) for i, x in enumerate(r)) for r in df.toLocalIterator())


def scanned(df: DataFrame) -> tuple[int, int]:
    """Rows and files that the scans of df have read, once df has run; pushed filters and pruning leave out what they skip."""

    def walk(p: object) -> tuple[int, int]:
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        children = p.children()
        if children.size() or "Scan" not in kind:
            below = [walk(children.apply(i)) for i in range(children.size())]
            return sum(x for x, _ in below), sum(x for _, x in below)
        found = [p.metrics().get(m) for m in ("numOutputRows", "numFiles")]
        rows, files = (int(m.get().value()) if m.isDefined() else 0 for m in found)
        return rows, files

    return walk(df._jdf.queryExecution().executedPlan())


def log_query(spark: SparkSession, path: str, state: str, sql: str, error: str = "", rows: int = 0, ms: int = 0, readrows: int = 0, nfiles: int = 0) -> None:
    """Appends one row to the log table."""
    row = spark.createDataFrame([(state, sql, error, readrows, rows, ms, nfiles)], "state string, sql string, error string, readrows long, rows long, ms long, nfiles long")
    row.select(F.current_timestamp().alias("time"), "*").write.mode("append").json(path)
