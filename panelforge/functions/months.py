"""Months as ``YYYY-MM`` text; their ordinal is 12 * year + month - 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(month: Column) -> Column:
    return (F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1).cast("int")


def month_text(index: Column) -> Column:
    return F.concat(F.lpad(F.floor(index / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((index % 12 + 1).cast("int").cast("string"), 2, "0"))


def add_months(month: Column, n: int | Column) -> Column:
    return month_text(month_index(month) + (F.lit(n) if isinstance(n, int) else n))


def month_diff(a: Column, b: Column) -> Column:
    """Months from a to b."""
    return month_index(b) - month_index(a)


def month_end(month: Column) -> Column:
    return F.last_day(F.to_date(F.concat(month, F.lit("-01"))))


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def index_of(month: str) -> int:
    """Driver-side ordinal."""
    return int(month[:4]) * 12 + int(month[5:7]) - 1


def text_of(index: int) -> str:
    return f"{index // 12:04d}-{index % 12 + 1:02d}"
