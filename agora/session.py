"""A session with the settings the engine expects, and the folder shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "agora", **conf: str) -> SparkSession:
    """Adaptive plans, skewed joins split, Arrow and UTC; the cluster's own settings win where they are set."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on one machine, a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if (held := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(held := tempfile.mkdtemp(prefix="agora-"))
    return held


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame as a Parquet table in the shared folder, for plans that read it several times."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A frame of fewer partitions than there are cores, as of one small file, dealt out anew; others stay as they are.

    For work that costs far more a row than moving it; where files are many, nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
