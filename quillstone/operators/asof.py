"""As-of joins: each row with the latest row of another table that is not after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of time, or units of a number, that one window goes through.
SLICE = 3_600_000_000


def _micros(df: DataFrame, at: str) -> Column:
    kind = dict(df.dtypes)[at]
    return F.unix_micros(F.col(at).cast("timestamp")) if kind.startswith("timestamp") else F.col(at).cast("long")


def latest_before(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, tie: str, name: str = "found", width: int = SLICE) -> DataFrame:
    """The rows of left with `name`: a struct of the row of right that is equal in `by` and latest at or before left's `at`.

    Of right rows at one time, the one with the greatest `tie` counts. Null where there is none, and where `by` or `at`
    is null in left; right rows with a null there are nobody's. Repeated rows of left stay. at: a timestamp or a whole
    number, in both.

    One union and one shuffle by key and slice of time: a window goes through one slice of one key, and what a slice takes
    over from earlier ones comes from a row for each slice. So a key that holds a third of all rows is spread over its
    slices; only its slices' last rows meet.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    there = F.lit(True)
    for c in (*by, at):
        there = there & F.col(c).isNotNull()
    kinds = {"_tie": dict(right.dtypes)[tie], "_l": left.schema, "_r": right.schema}

    def shaped(df: DataFrame, side: int, **own: Column) -> DataFrame:
        """Key, time and side of df's rows, and those of _tie, _l and _r that its side has."""
        cells = [own.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()]
        return df.where(there).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], _micros(df, at).alias("_at"), F.lit(side).alias("_side"), *cells)

    rows = shaped(left, 1, _l=F.struct(*left.columns))
    both = rows.unionByName(shaped(right, 0, _tie=F.col(tie), _r=F.struct(*right.columns))).withColumn("_slice", F.floor(F.col("_at") / width))

    within = Window.partitionBy(*keys, "_slice").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_r", F.last("_r", ignorenulls=True).over(within)).where("_side = 1")
    ends = both.groupBy(*keys, "_slice").agg(F.max_by(F.when(F.col("_side") == 0, F.col("_r")), F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).where("_before is not null").select(*keys, "_slice", "_before")
    found = rows.join(ends, [*keys, "_slice"], "left").select("_l.*", F.coalesce("_r", "_before").alias(name))
    return found.unionByName(left.where(~there).withColumn(name, F.lit(None).cast(right.schema)))
