"""Claims and links: coverage, gaps and relational division."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.folds import every


def pinned(claims: DataFrame, current: DataFrame, on: Sequence[str]) -> DataFrame:
    """Claims of the current version; claims do not move to a later one."""
    return claims.join(current.select(*on).distinct(), list(on), "left_semi")


def unlinked(claims: DataFrame, links: DataFrame, claim_id: str, when: Column | None = None) -> DataFrame:
    """Claims without a link (of those that `when` picks)."""
    picked = links if when is None else links.where(when)
    return claims.join(picked.select(claim_id).distinct(), claim_id, "left_anti")


def all_supported(owners: DataFrame, needs: DataFrame, supports: DataFrame, owner: str, need: str) -> DataFrame:
    """(owner, n_needs, supported): whether each need of an owner has a support; without needs: false."""
    met = needs.join(supports.select(need).distinct().withColumn("met", F.lit(True)), need, "left")
    found = met.groupBy(owner).agg(F.count(F.lit(1)).alias("n_needs"), every(F.col("met")).alias("all_met"))
    out = owners.select(owner).join(found, owner, "left")
    return out.select(owner, F.coalesce("n_needs", F.lit(0)).cast("long").alias("n_needs"), F.coalesce("all_met", F.lit(False)).alias("supported"))


def dangling(children: DataFrame, key: str, parents: DataFrame, parent_key: str, field: str) -> DataFrame:
    """(field, value, n): references of children that no parent has."""
    known = parents.select(F.col(parent_key).alias("value")).distinct()
    lost = children.select(F.col(key).alias("value")).where("value is not null").join(known, "value", "left_anti")
    return lost.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit(field).alias("field"), F.col("value").cast("string").alias("value"), "n")


def gates(rows: DataFrame, checks: Sequence[tuple[str, Column]], name: str = "missing") -> DataFrame:
    """rows with the messages of the failed checks in the given order; a null check fails."""
    messages = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in checks])
    return rows.withColumn(name, F.array_compact(messages))


def diff(before: DataFrame, after: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, change): added, removed or changed between two snapshots, null-safe."""
    a = before.select(*key, F.col(value).alias("value_before"), F.lit(True).alias("in_before"))
    b = after.select(*key, F.col(value).alias("value_after"), F.lit(True).alias("in_after"))
    both = a.join(b, list(key), "full_outer")
    change = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").when(~F.col("value_before").eqNullSafe(F.col("value_after")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*key, "change")
