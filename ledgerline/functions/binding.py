"""Expressions that use a value several times without computing it again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value computed once a row: Spark computes each mention anew inside branches and functions of arrays."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
