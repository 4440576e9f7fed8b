"""Naming an intermediate value inside one column expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often it is used.

    The optimizer pastes a column's expression into every filter and projection that
    mentions it. Steps that use the step before several times would grow by that factor
    each; a bound value stays one.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
