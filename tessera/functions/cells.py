"""Small Column helpers that the rule functions share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def has_any(text: Column, parts) -> Column:
    """Whether ``text`` contains one of ``parts``; false for null."""
    return F.coalesce(any_of(text.contains(p) for p in parts), F.lit(False))


def clean(text: Column) -> Column:
    return F.lower(F.trim(text))


def lookup(text: Column, table: dict) -> Column:
    """The value of a constant table, null where the key is unknown."""
    if not table:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), text)


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def labels(pairs) -> Column:
    """The labels, in order, of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(c, label if isinstance(label, Column) else F.lit(label)) for c, label in pairs]))
