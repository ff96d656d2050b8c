"""A PySpark engine for a small forgiving SQL dialect over plain data files."""

from plainsql.engine import Engine

__all__ = ["Engine"]
