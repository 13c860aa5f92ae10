"""Session settings the library relies on."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Grouped functions travel to the executors by value: no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

# Runtime settings every query needs for right results or safe plans. None of
# them depends on the size of the cluster, so they are safe to set on any session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  name: str = "gridwatt") -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return prepare(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    Only a local master, where driver and executors are one process, may go without: it gets a folder of
    its own once. On a cluster a missing setting is an error, since other machines would not see such files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="gridwatt-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for this application under the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{checkpoint_dir(spark).rstrip('/')}/gridwatt-{app}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder once and read it from there.

    For daily tables that one plan reads several times: without it every reading repeats the
    scan and the shuffle of the facts below. The written table survives the loss of executors,
    cuts the lineage, and has sizes the optimizer can see.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
