"""Exact order of timestamps with fractions of any length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(Z|[+-]\d{2}:?\d{2})$"


def timestamp_key(value: Column) -> Column:
    """struct(seconds, fraction): sorts like the instants; the fraction's digits without zeros at the end. Null for what is
    no timestamp with a zone."""
    part = lambda i: F.regexp_extract(value, PATTERN, i)
    second = F.when(part(6) == "", "00").otherwise(part(6))
    zone = F.when(part(8) == "Z", "+0000").otherwise(F.regexp_replace(part(8), ":", ""))
    offset = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")) * 60
    text = F.concat_ws(" ", F.concat_ws("-", part(1), part(2), part(3)), F.concat_ws(":", part(4), part(5), second))
    local = F.unix_seconds(F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX")))
    seconds = local - F.when(F.substring(zone, 1, 1) == "-", -offset).otherwise(offset)
    return F.when(value.rlike(PATTERN) & seconds.isNotNull(), F.struct(seconds.alias("seconds"), F.regexp_replace(part(7), "0+$", "").alias("fraction")))
