"""Session settings that the operators assume."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: UTC everywhere; adaptive plans split skewed joins and merge small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tessera", **settings: str) -> SparkSession:
    """A session with SETTINGS; a setting `a__b` stands for `a.b`."""
    builder = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir. Only a local master may go without it."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return tempfile.mkdtemp(prefix="tessera-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over the cluster by keys that tell most rows apart: a task reads whole row groups, so a slim table, which has few of
    them, would keep few cores busy with all the work on its rows."""
    return df.repartition(*keys)
