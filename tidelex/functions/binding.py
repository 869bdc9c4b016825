"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    Without it a chain of steps that read their input several times doubles in
    size with each step as soon as the optimizer moves a filter below it.
    """
    return F.transform(F.array(value), lambda bound: body(bound))[0]
