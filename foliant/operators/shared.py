"""Lineage cuts in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Written to spark.checkpoint.dir and read back.

    Where none is named, a session on one machine (master local) gets a temporary folder; on a cluster, where executors would
    each write to a disk of their own, that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliant-"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A path of its own in that folder, for a table that is written and read again. What is there goes when the driver ends."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(1))
    root = f"{spark.sparkContext.getCheckpointDir()}/scratch"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{root}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """As `cut`, but in Parquet, which takes long texts in a fraction of the room and gives back only the columns that are asked for."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Each name, or the first variant of it that no column has, as Spark compares names."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
