"""The session that tests, bench and ad-hoc runs use; on a cluster the session is given."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    own = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName("quillstone").config(map=own).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
