"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded_ratio(over: Column, under: Column) -> Column:
    """over / under, null where under is 0."""
    return F.when(under != 0, over / under)


def token(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")


def path_text(*parts: Column) -> Column:
    return F.concat_ws(" -> ", *parts)


def near(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)
