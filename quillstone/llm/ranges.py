"""Numbering of sorted rows without one task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from quillstone.llm.common import row_key, stored


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `__at`: the row's number, from 1, in its unbroken run of equal `__run_key` within the partition."""
    last, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index("__run_key")).to_numpy(zero_copy_only=False)
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        starts = np.flatnonzero(new)
        at = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys)))) + 1
        if last is not None and keys[0] == last:
            at[: starts[1] if len(starts) > 1 else len(keys)] += held
        last, held = keys[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64))], [*batch.schema.names, "__at"])


def numbered(df: DataFrame, run: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows of df with `at`: each row's place, from 1, among the rows that are equal in the run columns, by `order`.

    Rows that are equal in `order` too are numbered in any order, each once. No run columns: all rows are one run. An
    empty table gives no rows. Names that begin with two underscores are taken here.

    The rows are sorted over ranges of (run, order, row), so that a run of any size is spread over many tasks, and equal
    rows too. A task numbers its rows; what a run has in earlier ranges comes from one row for each range, and there are
    spark.sql.shuffle.partitions of these.
    """
    own = df.columns
    fixed = stored(df.withColumn("__tie", F.monotonically_increasing_id()), "unsorted")
    keys = [*[F.col(c).asc_nulls_first() for c in run], *order, F.col("__tie").asc()]
    ranged = fixed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.select(*own, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__seq"), (row_key(*run) if run else F.lit(0).cast("long")).alias("__run_key"))
    ranged = stored(ranged.mapInArrow(_count_runs, StructType([*ranged.schema.fields]).add("__at", LongType())), "ranges")

    ends = ranged.groupBy("__part").agg(F.min_by("__run_key", "__seq").alias("__first"), F.max_by("__run_key", "__seq").alias("__last"), F.max_by("__at", "__seq").alias("__n"))
    ends = ends.select("__part", F.explode(F.array(F.struct(F.lit(0).alias("__tail"), F.col("__first").alias("__run_key"), F.lit(0).cast("long").alias("__n")), F.struct(F.lit(1).alias("__tail"), F.col("__last").alias("__run_key"), F.col("__n")))).alias("e"))
    upto = Window.partitionBy("__run_key").orderBy("__part", "__tail").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("__part", "e.*").withColumn("__before", F.sum("__n").over(upto)).where((F.col("__tail") == 0) & (F.col("__before") > 0))
    before = stored(before.select("__part", "__run_key", "__before"), "before")
    return ranged.join(before, ["__part", "__run_key"], "left").select(*own, (F.col("__at") + F.coalesce("__before", F.lit(0))).alias("at"))
