"""Checks of an append-only chain: each row stores its predecessor's hash, so that every check is local to a pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_links(rows: DataFrame, project: Sequence[str], order: str, prev: str, sha: str) -> DataFrame:
    """rows with link_ok: prev is the sha of the row before (null for the first)."""
    before = F.lag(sha).over(Window.partitionBy(*project).orderBy(order))
    return rows.withColumn("link_ok", F.col(prev).eqNullSafe(before))


def check_sequence(rows: DataFrame, project: Sequence[str], order: str, seq: str, event_id: str) -> DataFrame:
    """rows with seq_ok: seq counts from 1 and the id is EV- and six digits of it at least."""
    at = F.row_number().over(Window.partitionBy(*project).orderBy(order))
    return rows.withColumn("seq_ok", F.col(seq).eqNullSafe(at.cast("long")) & F.col(event_id).eqNullSafe(F.format_string("EV-%06d", at)))


def head(rows: DataFrame, project: Sequence[str], order: str, sha: str) -> DataFrame:
    return rows.groupBy(*project).agg(F.count(F.lit(1)).alias("event_count"), F.max_by(sha, order).alias("head"))
