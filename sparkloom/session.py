"""Sessions with the settings that the engine's semantics rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: ANSI errors instead of silent nulls, timestamps in UTC, plans that are adapted at run time.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "sparkloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; settings given here, with _ for ., come on top."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all machines of a cluster share; on a single machine, where
    that is unset, in one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("on a cluster set spark.checkpoint.dir to a folder that all its machines share")
        base = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{uuid.uuid4().hex}"
