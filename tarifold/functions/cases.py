"""Small builders for conditional and table-driven columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def col(value) -> Column:
    """A column as it is, anything else as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def first_case(cases: Iterable[tuple[Column, object]], default=None) -> Column:
    """Value of the first condition that holds, as one flat CASE."""
    out = None
    for condition, value in cases:
        out = F.when(condition, col(value)) if out is None else out.when(condition, col(value))
    return out.otherwise(col(default))


def apart(column: Column) -> Column:
    """The column as it is, computed by an array function, which Spark keeps out of whole-stage code.

    A projection of many branches outgrows the 8,000 bytes up to which HotSpot compiles a method if it is one whole-stage method.
    With one such column beside it, it is compiled in small methods instead. The column itself is interpreted, so it should be a plain one.
    """
    return F.get(F.transform(F.array(column), lambda x: x), F.lit(0))


def text_literal(value) -> str:
    """A Python value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def mapped(key: Column, table: dict) -> Column:
    """Value of a key in a small fixed table, null when absent; the literal map is folded once per plan."""
    pairs = ", ".join(text_literal(v) for pair in table.items() for v in pair)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def keyword_class(text: Column, hints: Iterable[tuple[str, str]], default=None) -> Column:
    """Class of the first hint contained in a text; order the specific hints before the general ones."""
    return first_case(((F.contains(text, F.lit(hint)), name) for hint, name in hints), default)
