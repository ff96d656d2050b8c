"""The engine: tables, views, functions and variables of a session, and statements over them."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsql.functions import scalars
from plainsql.operators.semantics import Value, double
from plainsql.plans.parser import Source, SqlError, parse
from plainsql.plans.planner import Planner
from plainsql.sources import files, sinks


class Ran(NamedTuple):
    """What a statement made and read, in rows, files and milliseconds."""

    rows: int
    readrows: int
    nfiles: int
    ms: int


class Engine:
    """``aggregate``: running (a value for each row so far) or final. ``order_by``: a column that orders running aggregates
    instead of the order of the scan. ``security`` forbids commands as tables. ``log``: folder of the query log.
    """

    def __init__(self, spark: SparkSession, folder: str = ".", aggregate: str = "running", order_by: str | None = None, security: bool = True, log: str | None = None) -> None:
        self.spark, self.folder, self.aggregate, self.order_by, self.security, self.log = spark, folder, aggregate, order_by, security, log
        self.tables: dict[str, DataFrame] = {}
        self.views: dict[str, tuple[str, list[str], str]] = {}  # name -> kind, parameters, text
        self.variables: dict[str, Value] = {}
        self.indexes: dict[str, tuple[str, str]] = {}  # name -> table, column

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def register_function(self, name: str, least: int, most: int | None, build: scalars.Built) -> None:
        """``build`` makes a Value from Values."""
        scalars.register(name, least, most, build)

    def sql(self, text: str) -> DataFrame:
        with self._logged(text) as done:
            out = self._run(parse(text))
            done("planned", Ran(0, 0, 0, 0))
        return out

    def execute(self, text: str, use: Callable[[DataFrame], tuple[int, DataFrame]] | None = None) -> Ran:
        """Runs a statement to its end and logs that. ``use`` gets the result and returns how many rows it took, and of
        which frame; without it they are counted in the tasks that make them."""
        with self._logged(text) as done:
            began = time.time()
            df = self._run(parse(text))
            # By the frame's own plan, whose scans then know what they have read.
            rows, df = use(df) if use else (df._jdf.queryExecution().toRdd().count(), df)
            ran = Ran(rows, *sinks.scanned(df), int(1000 * (time.time() - began)))
            done("end", ran)
        return ran

    @contextmanager
    def _logged(self, text: str) -> Iterator[Callable[[str, Ran], None]]:
        began = time.time()

        def done(state: str, ran: Ran, error: str = "") -> None:
            if self.log:
                sinks.log_query(self.spark, self.log, state, text, error, ran.rows, int(1000 * (time.time() - began)), ran.readrows, ran.nfiles)

        try:
            yield done
        except Exception as e:
            done("error", Ran(0, 0, 0, 0), str(e))
            raise

    def scan(self, text: str, f: Callable, schema: str) -> DataFrame:
        """A callback over the rows of a statement: f takes an iterator of pandas frames and yields such of the schema."""
        return self.sql(text).mapInPandas(f, schema)

    def each(self, text: str, f: Callable) -> None:
        """Calls f with each row of a statement, in the tasks that have them."""
        self.sql(text).foreach(f)

    def script(self, text: str) -> DataFrame | None:
        """Statements between semicolons; the last one's result."""
        out = None
        for part in text.split(";"):
            if part.strip():
                out = self.sql(part)
        return out

    def _run(self, s: tuple) -> DataFrame:
        if s[0] == "select":
            out = Planner(self, s[1]).plan()
            return sinks.lines(out, s[1].format) if s[1].format else out
        if s[0] == "set":
            self.variables[s[1]] = v = Planner(self, parse("select 1")[1]).value(s[2])
            return self.spark.range(1).select(v.column.alias(s[1]))
        if s[0] in ("view", "function"):
            self.views[s[1]] = s[0], s[2], s[3]
            return self.catalog().where(F.col("name") == s[1])
        self.indexes[s[1]] = s[2], s[3]
        return self.index_report(s[2], s[3], s[1])

    def constant(self, v: Value) -> float:
        """The number a column without references stands for."""
        if v.literal is not None:
            return v.literal
        return self.spark.range(1).select(double(v).alias("x")).first()["x"]

    def index_report(self, table: str, column: str, name: str) -> DataFrame:
        """Entries and distinct keys of what an index would hold; Spark needs none to join."""
        df = self.table(Source("file", table), [])
        c = F.col(f"`{column}`")
        return df.agg(F.lit(name).alias("name"), F.count(c).alias("entries"), F.countDistinct(c).alias("distinct_keys"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most"))

    def catalog(self) -> DataFrame:
        rows = [("table", n, "", "", "") for n in self.tables] + [(k, n, ",".join(p), t, "") for n, (k, p, t) in self.views.items()]
        return self.spark.createDataFrame(rows, "type string, name string, params string, `select` string, impl string")

    def index_list(self) -> DataFrame:
        return self.spark.createDataFrame([(n, t, c) for n, (t, c) in self.indexes.items()], "name string, table string, `column` string")

    def table_list(self) -> DataFrame:
        """Views and tables, registered or files of the folder, and the lines of delimited files."""
        known = [("table", n) for n in self.tables] + [("view", n) for n in self.views]
        names = files.listed(self.spark, self.folder)
        known += [("view", n) for n in names if n.endswith(".sql")] + [("table", n) for n in names if n.endswith(".parquet")]
        out = self.spark.createDataFrame(known, "type string, name string").withColumn("lines", F.lit(None).cast("long"))
        if texts := [n for n in names if n.endswith(".csv")]:
            lines = self.spark.read.text([f"{self.folder}/{n}" for n in texts]).groupBy(F.regexp_extract(F.input_file_name(), r"([^/]+\.csv)(/[^/]*)?$", 1).alias("name")).agg(F.count(F.lit(1)).alias("lines"))
            named = self.spark.createDataFrame([("table", n, n.replace(" ", "%20")) for n in texts], "type string, name string, written string")
            out = out.unionByName(named.join(lines.withColumnRenamed("name", "written"), "written", "left").select("type", "name", F.coalesce("lines", F.lit(0)).alias("lines")))
        return out

    def describe(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in self.table(Source("file", table), []).schema], "name string, type string")

    def table(self, s: Source, args: list[Value]) -> DataFrame:
        """Registered tables, views and functions by name, then files: as given, in the folder, with .csv, .sql or .parquet added."""
        name = s.name
        if name in ("$view", "$index", "$table"):
            return {"$view": self.catalog, "$index": self.index_list, "$table": self.table_list}[name]()
        if name in self.tables:
            return self.tables[name]
        if name in self.views:
            _, params, text = self.views[name]
            if len(args) != len(params):
                raise SqlError(f"{name}() takes {len(params)} arguments, not {len(args)}")
            return self.inner(dict(zip(params, args, strict=True))).sql(text)
        if name.rstrip().endswith("|"):
            return self.command(name.rstrip()[:-1], s.columns)
        for path in [p + end for p in (name, f"{self.folder}/{name}") for end in ("", ".csv", ".sql", ".parquet")]:
            if files.exists(self.spark, path):
                if path.endswith(".sql"):
                    return self.inner({}).script(files.read_text(self.spark, path))
                if path.endswith(".parquet"):
                    return self.spark.read.parquet(path)
                if path.endswith(".json"):
                    return self.spark.read.json(path)
                return files.read_delimited(self.spark, path, s.columns)
        raise SqlError(f"no table {name}")

    def inner(self, variables: dict[str, Value]) -> Engine:
        e = Engine(self.spark, self.folder, self.aggregate, self.order_by, self.security)
        e.tables, e.views, e.indexes, e.variables = self.tables, self.views, self.indexes, self.variables | variables
        return e

    def command(self, command: str, columns: list[str] | None) -> DataFrame:
        """Lines that a shell command prints on the driver, small tables only. Denied unless security is off."""
        if self.security:
            raise SqlError("commands as tables are not allowed")
        lines = subprocess.run(command, shell=True, capture_output=True, text=True, check=True).stdout.splitlines()
        names = columns or [n.strip() for n in lines.pop(0).split(files.sniff(lines[0]))]
        d = files.sniff("" if len(names) == 1 else (lines or [""])[0])
        rows = [(cells + [None] * len(names))[: len(names)] for cells in ([c.strip() or None for c in line.split(d)] for line in lines if line.strip())]
        return self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
