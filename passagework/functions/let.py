"""Bind an expression once inside a larger one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    A lambda that mentions an outer expression would compute it again for every
    element; a lambda variable holds the finished value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
