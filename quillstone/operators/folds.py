"""Folds of event tables: latest rows, versions, retractions, aliases. No fold depends on the order of arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; a hash aggregate with map-side combining, not a window over the key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "version") -> DataFrame:
    """Versions from 1 per key, in order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def last_value_first_place(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the columns of the last, and the place of the first (as a map that is written again and again)."""
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last"), F.min(order).alias("first_place"))
    return found.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest], "first_place")


def effective(confirmed: DataFrame, retracted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Confirmations that are never retracted, before or after."""
    return confirmed.join(retracted.select(*on).distinct(), list(on), "left_anti")


def unique_aliases(rows: DataFrame, key: str, aliases: Sequence[str]) -> DataFrame:
    """(alias, key) of the aliases that resolve to exactly one key."""
    each = F.explode(F.array_distinct(F.array(*[F.col(a).cast("string") for a in aliases]))).alias("alias")
    found = rows.select(F.col(key).alias("key"), each).where("alias is not null")
    return found.groupBy("alias").agg(F.min("key").alias("key"), F.max("key").alias("other")).where("key = other").select("alias", "key")


def every(condition: Column) -> Column:
    """bool_and over rows where nothing is true of none: an empty group is true, null counts as false."""
    return F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True))


def some(condition: Column) -> Column:
    return F.coalesce(F.bool_or(F.coalesce(condition, F.lit(False))), F.lit(False))
