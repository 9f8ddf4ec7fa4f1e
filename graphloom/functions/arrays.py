"""Arrays with positions from 1, as level lists have them; positions out of range read as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(values: Column | str, position: int) -> Column:
    """The element at a position from 1, null where there is none."""
    return F.get(values, F.lit(position - 1))


def put(values: Column | str, position: int, value: Column) -> Column:
    """values with one element replaced."""
    return F.transform(values, lambda x, i: F.when(i == position - 1, value).otherwise(x))


def filled(value: int, n: int) -> Column:
    return F.array_repeat(F.lit(value), n)


def brackets(text: Column | str) -> Column:
    """{...} as [...]."""
    return F.translate(text, "{}", "[]")


def long_list(text: Column | str) -> Column:
    """The bigint array that a brace list spells."""
    inside = F.trim(F.translate(text, "{}", "  "))
    return F.when(inside == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(inside, ","), lambda x: F.trim(x).cast("bigint")))
