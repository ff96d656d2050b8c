"""Statements from the command line, from files or from standard input.

    python -m plainsql [--batch] [--csv | --format=csv|bar|tab] [--[no-]echo] [--[no-]stats] [--[no-]force] [--[no-]security]
                       [--folder=DIR] [--log=DIR] [--init=FILE] [--interactive] [STATEMENT ...]

Options and statements take effect one after another. Without a statement, lines of standard input are run until ``exit`` or
``quit``. An error ends the run with 1 unless --force is on or lines are typed in.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from plainsql.engine import Engine
from plainsql.sources import files, sinks

SWITCHES = ("echo", "stats", "force", "security", "interactive")
LAST = ("exit", "quit")


class Session:
    def __init__(self, engine: Engine, out: TextIO) -> None:
        self.engine, self.out, self.format, self.asked, self.failed = engine, out, "tab", False, False
        self.on = {"echo": True, "stats": True, "force": False, "security": engine.security, "interactive": False}

    def print(self, *lines: str) -> None:
        for line in lines:
            print(line, file=self.out)

    def show(self, df: DataFrame) -> tuple[int, DataFrame]:
        """Prints rows as they come and counts them; the frame that they come from."""
        if self.format == "csv":
            df, n = sinks.lines(df, "csv"), 0
            self.print(df.columns[0])
            made = (r[0] for r in df.toLocalIterator())
        else:
            made, n = sinks.shown(df, self.format), -2
        for line in made:
            self.print(line)
            n += 1
        return n, df

    def run(self, text: str) -> None:
        if self.on["echo"]:
            self.print(f"SQL> {text}")
        try:
            ran = self.engine.execute(text, self.show)
        except Exception as e:
            self.failed = True
            self.print(f"% {str(e).splitlines()[0]}")
            return
        if self.on["stats"]:
            self.print("", f"{ran.rows} rows in {max(1, ran.ms)} ms (read {ran.readrows} lines)")

    def option(self, name: str, value: str | None) -> None:
        plain, on = (name[3:], False) if name.startswith("no-") else (name, value not in ("0", "no", "off"))
        if plain in SWITCHES:
            self.on[plain] = on
            self.engine.security = self.on["security"]
        elif plain == "batch":
            self.format = "csv" if on else "tab"
            self.on |= {"echo": not on, "stats": not on, "interactive": not on}
        elif name == "csv" or name == "format" and value in sinks.SEPARATORS:
            self.format = value or "csv"
        elif name == "folder" and value:
            self.engine.folder = value
        elif name == "log" and value:
            self.engine.log = value
        elif name == "init" and value:
            self.lines(files.read_text(self.engine.spark, value).splitlines())
        else:
            raise SystemExit(f"unknown option --{name}{'' if value is None else '=' + value}\n{__doc__}")

    def argument(self, text: str) -> None:
        if text.startswith("--"):
            name, _, value = text[2:].partition("=")
            self.option(name, value or None)
        else:
            self.asked = True
            self.run(text)

    def lines(self, source: Iterable[str], ask: bool = False) -> None:
        """Each line is an option or a statement."""
        for line in source:
            if line.strip() in LAST:
                return
            if line.strip():
                self.argument(line.strip())
            if self.failed and not self.on["force"] and not ask:
                return
            if ask:
                print("SQL> ", end="", file=self.out, flush=True)


def main(arguments: list[str], spark: SparkSession | None = None, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> int:
    if spark is None:
        spark = SparkSession.builder.appName("plainsql").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    session = Session(Engine(spark), out)
    waiting = list(arguments)
    while waiting:
        text = waiting.pop(0)
        if text == "--init" and waiting:
            text = f"--init={waiting.pop(0)}"
        session.argument(text)
        if session.failed and not session.on["force"]:
            return 1
    if session.on["interactive"] or not session.asked:
        ask = session.on["interactive"]
        session.on["echo"] &= not ask
        if ask:
            print("SQL> ", end="", file=out, flush=True)
        session.lines(lines, ask)
        return int(session.failed and not ask and not session.on["force"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
