"""Values by path out of XML and JSON texts. Every step of a path matches at any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(path: str) -> list[str]:
    return [s for s in re.split(r"[./]", path) if s]


def _find_xml(text: str, wanted: tuple[str, ...]) -> list[str]:
    """Texts within elements of the last name that stand below the other names, one below the other."""
    found: list[str] = []
    above: list[tuple[int, bool]] = [(0, False)]  # names met on the way here, and whether texts count
    last = len(wanted) - 1

    def start(name: str, _: dict) -> None:
        met = above[-1][0]
        above.append((met + (met < last and name == wanted[met]), met == last and name == wanted[last]))

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: above.pop()
    parser.CharacterDataHandler = lambda data: found.append(data) if above[-1][1] else None
    try:
        parser.Parse(text, True)
    except (expat.ExpatError, UnicodeEncodeError):
        return []
    return found


def _xml_values(texts: pd.Series, paths: pd.Series) -> pd.Series:
    def one(t: str | None, path: str | None) -> list[str] | None:
        if t is None or path is None:
            return None
        wanted = _split(path)
        return _find_xml(t, wanted) if wanted and wanted[-1] in t else []

    return pd.Series([one(t, p) for t, p in zip(texts, paths, strict=True)])


def xml_values(text: Column, path: str | Column) -> Column:
    """array<string> of the texts of all matching elements, in document order. Text that is not well-formed has none.

    Spark's xpath ends the query at the first such text, so this is a pandas UDF.
    """
    return F.pandas_udf(_xml_values, "array<string>")(text, F.lit(path) if isinstance(path, str) else path)


def _find(node: object, wanted: list[str]) -> Iterator[str]:
    if isinstance(node, list):
        for x in node:
            yield from _find(x, wanted)
    elif isinstance(node, dict):
        for k, x in node.items():
            if k == wanted[0] and len(wanted) == 1:
                yield x if isinstance(x, str) else json.dumps(x)
            yield from _find(x, wanted[1:] if k == wanted[0] and len(wanted) > 1 else wanted)


@cache
def _split(path: str) -> tuple[str, ...]:
    return tuple(steps(path))


def _json_values(texts: pd.Series, paths: pd.Series) -> pd.Series:
    def one(t: str | None, path: str | None) -> list[str] | None:
        if t is None or path is None:
            return None
        wanted = list(_split(path))
        if not wanted or wanted[-1] not in t:
            return []
        try:
            node = json.loads(t)
        except ValueError:
            try:
                node = json.loads(re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', t))
            except ValueError:
                return []
        return list(_find(node, wanted))

    return pd.Series([one(t, p) for t, p in zip(texts, paths, strict=True)])


def json_values(text: Column, path: str | Column) -> Column:
    """array<string> of all matching values; keys may lack quotes. Text that is no JSON has none.

    Spark's own JSON functions take a path from the root only, so this is a pandas UDF.
    """
    return F.pandas_udf(_json_values, "array<string>")(text, F.lit(path) if isinstance(path, str) else path)
