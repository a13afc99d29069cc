"""Latest-per-key folds by Structured Streaming; they give what the batch folds give."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.storage import shared_dir


def latest_stream(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """The fold of a streaming table; by order alone, so late rows count and no watermark drops any."""
    last = F.max_by(F.struct(order, *values), order).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def fold_table(spark: SparkSession, path: str, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Streams a Parquet table through latest_stream() until all of it is read, and returns the folded rows.

    Each micro-batch writes its updated keys as files of its own number, so that a batch that runs again replaces its
    own output; the last update of a key is the fold.
    """
    schema = spark.read.parquet(path).schema
    # a single file or a folder of files: the stream reads the folder above with a filter on the name
    parent, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent) if _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)
    at = f"{shared_dir(spark)}/quillstone/fold-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    folded = latest_stream(source.select(*keys, order, *values), keys, order, values)
    stream = folded.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    stream.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    last = F.max_by(F.struct(order, *values), order).alias("last")
    return out.groupBy(*keys).agg(last).select(*keys, "last.*")


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
