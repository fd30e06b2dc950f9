"""Names for subexpressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` once in the tree, however often ``body`` uses it.

    Nested functions of one column otherwise multiply, and planning time with them.
    """
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)
