"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build(name: str = "tidemark", **conf: str) -> SparkSession:
    """UTC and ANSI semantics; adaptive execution splits skewed joins and merges small partitions.

    The number of shuffle partitions and the size of input splits are left to the cluster's own configuration.
    """
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one where none is named, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
