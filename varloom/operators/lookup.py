"""Left lookups in tables that may hold a key more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """keys and value, one row per key: the row that is last in the given order.

    An aggregate with a partial step, so a key with many rows has shrunk before
    the shuffle. Rows with a null key are left out; null order values come first.
    """
    known = df.filter(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0)
    return known.groupBy(*keys).agg(F.max(F.struct(*order, value))[value].alias(value))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """rows with `value` of the last matching row of the table, null where there is none.

    The table, one row per key by then, carries no hint: adaptive execution
    broadcasts it where its measured bytes are few, and else splits hot keys.
    """
    return rows.join(latest(table, keys, value, *order), keys, "left")


def in_frequency_range(af: Column, least: float = 0.0, most: float = 0.05) -> Column:
    """The frequency, rounded to four places and 0 where unknown, lies in the range, both ends included."""
    return F.coalesce(F.round(af, 4), F.lit(0.0)).between(least, most)
