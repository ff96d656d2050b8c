"""Delimited text and other files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Delimiters in the order in which a tie goes to the later one.
DELIMITERS = ",;:\t|"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def sniff(line: str) -> str:
    """The delimiter that occurs most in the line."""
    return max(DELIMITERS, key=lambda d: (line.count(d), DELIMITERS.index(d)))


def _body(quote: str) -> str:
    """What may stand between quotes: the quote doubled, anything after a backslash, all else."""
    return rf"[^{quote}\\]*+(?:(?:\\[\s\S]|{quote}{quote})[^{quote}\\]*+)*+"


def _field(delimiter: str) -> str:
    """A field: quoted at its start by either mark, or plain with backslashes; blanks may lead."""
    d = "\\" + delimiter
    return rf"""(?:[^\S\n{d}]*+(?:"{_body('"')}"|'{_body("'")}')[^{d}\n]*+|(?:[^{d}\\\n]|\\[\s\S])*+)"""


def _clean(raw: Column) -> Column:
    """The value of a field: empty, NULL, null and \\N without quotes are null."""
    c = F.ltrim(raw)
    out = F.when(~c.isin("", "NULL", "null", "\\N"), F.when(c.contains("\\"), F.regexp_replace(c, r"\\([\s\S])", "$1")).otherwise(c))
    # Few fields are quoted, so the patterns stand behind a look at the first character.
    for q in "\"'":
        inner = F.regexp_extract(c, rf"^{q}({_body(q)}){q}", 1)
        out = F.when(c.startswith(q) & c.rlike(rf"^{q}{_body(q)}{q}"), F.regexp_replace(inner, rf"{q}({q})|\\([\s\S])", "$1$2")).otherwise(out)
    return out


def _odd(text: Column) -> Column:
    return text.contains('"') | text.contains("'") | text.contains("\\")


def _cells(text: Column, delimiter: str) -> Column:
    """Fields of a line as they stand in it. Patterns only where there is a quote or a backslash."""
    return F.when(~_odd(text), F.split(text, rf"\{delimiter}")).otherwise(F.regexp_extract_all(text, F.lit(rf"({_field(delimiter)})(?:\{delimiter}|$)"), F.lit(1)))


def fields(text: Column, delimiter: str = ",") -> Column:
    """array<string> of the values in a line of delimited text, as a table would have them."""
    return F.transform(_cells(text, delimiter), _clean)


def as_number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), F.trim(c).cast("double"))


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, multiline: bool | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """A text table. Without ``columns`` the first line names them. A column whose values are all numbers becomes double.

    Fields may start with a double or a single quote; the quote is then doubled or escaped inside, and delimiters and ends of
    lines are text. A backslash takes the next character as it is. Short rows are filled with nulls, longer ones cut; empty
    cells, NULL, null and \\N are null; blank lines are skipped. Lines are parsed by native expressions, so a file is split among
    tasks, unless a quote reaches over the end of a line: then each file is read whole. One pass finds that and the types;
    ``multiline`` and ``types`` (name -> double or string) spare it.
    """
    first = spark.read.text(path).where(F.trim("value") != "").first()
    line = first[0] if first else ""
    delimiter = sniff("" if columns and len(columns) == 1 else line)
    field = _field(delimiter)
    names = columns or [n.strip() for n in spark.range(1).select(fields(F.lit(line), delimiter).alias("x")).first()["x"] if n is not None]

    def table(whole: bool) -> DataFrame:
        text = F.regexp_replace("value", "\r", "")
        if whole:
            # A backslash before the end of a line joins the next one to it.
            records = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all(text, F.lit(rf"((?:{field}\{delimiter})*+{field})(?:\n|$)"), F.lit(1))).alias("value"))
            records = records.select(F.regexp_replace("value", r"\\\n", "").alias("value"))
        else:
            records = spark.read.text(path).select(text.alias("value"))
        records = records.where(F.trim("value") != "")
        if columns is None:
            records = records.where(F.col("value") != line.replace("\r", ""))
        return records.select("value", _cells(F.col("value"), delimiter).alias("cells"))

    clean = lambda df: df.select(*(_clean(F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(names)))
    if multiline is None or types is None:
        # Whether a field starts with a quote that the line doesn't close, or a line ends with a backslash.
        left = F.regexp_replace("value", rf"""(?:^|(?<=\{delimiter}))[^\S\n]*+(?:"{_body('"')}"|'{_body("'")}')""", "")
        over = left.rlike(rf"""(?:^|\{delimiter})\s*["']|\\$""")
        over = F.when(_odd(F.col("value")), over).otherwise(False)
        numbers = [F.coalesce(F.bool_and(_clean(F.get("cells", F.lit(i))).rlike(NUMBER)), F.lit(False)).alias(f"c{i}") for i in range(len(names))]
        found = table(bool(multiline)).agg(F.max(over).alias("over"), *numbers).first()
        if multiline is None and (multiline := bool(found["over"])) and types is None:
            found = table(True).agg(*numbers).first()
        types = types or {n: "double" if found[f"c{i}"] else "string" for i, n in enumerate(names)}
    return clean(table(multiline)).select(*(as_number(F.col(f"`{n}`")).alias(n) if types.get(n) == "double" else F.col(f"`{n}`") for n in names))


def exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop's file systems, so any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder, sorted."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(x.getPath().getName() for x in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
