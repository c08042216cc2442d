"""The shared folder for checkpoints, as the cluster names it."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def ready(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the cluster's folder, or one on this machine where a local session names none."""
    root = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if spark.sparkContext.getCheckpointDir() is None:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        if not root and not local:
            raise ValueError(f"{KEY} must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="lagweave-"))
