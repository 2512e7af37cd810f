"""The session every entry point uses."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quantloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow on. Cluster settings win where they are given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map=defaults | conf).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a local master gets one in its own temp folder; a cluster must name it.
    """
    spark = df.sparkSession
    ctx = spark.sparkContext
    if not ctx.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not (ctx.master == "local" or ctx.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = "file://" + os.path.join(tempfile.gettempdir(), "quantloom-checkpoints")
        ctx.setCheckpointDir(path)
    return df.checkpoint()
