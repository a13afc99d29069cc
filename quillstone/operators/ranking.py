"""Weighted, gated ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_score(scores: Sequence[Column], weights: Sequence[Column | float], penalty: Column) -> Column:
    """Sum of score / 4 * weight share * 100 less the penalty, within 0 and 100, two places, halves up.

    Weights are numbers or columns. The sum is taken in the order of the dimensions; a null score makes the result null.
    """
    columns = [w if isinstance(w, Column) else F.lit(float(w)) for w in weights]
    total = columns[0]
    for w in columns[1:]:
        total = total + w
    points = F.lit(0.0)
    for score, weight in zip(scores, columns, strict=True):
        points = points + score / F.lit(4.0) * (weight / total) * F.lit(100.0)
    bounded = F.least(F.greatest(points - penalty, F.lit(0.0)), F.lit(100.0))
    return F.when(points.isNotNull() & penalty.isNotNull(), F.floor(bounded * 100 + 0.5) / 100)


def utf16_key(column: str) -> Column:
    """Sorts strings by UTF-16 units."""
    return F.encode(F.col(column), "UTF-16BE")
