"""Binding a value in a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value taken once a row. Lambda bodies are evaluated for each element, and
    Spark would take an expression again each time it stands in one; a lambda over a one-element array
    binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of named values, each taken once a row."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)
