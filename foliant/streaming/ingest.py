"""Incremental integration: every micro-batch adds its new records to a table, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import digest, integrate
from ..operators.runs import next_state


def add_batch(spark: SparkSession, path: str, dimension: DataFrame, fallback: str):
    """For foreachBatch. Rows go to a folder of their batch, written over on a retry, so a batch that runs twice adds once; what other batches wrote is what exists.

    Rows carry the digest of their normal front (front_key), so of the table a batch reads 32 bytes a row and the two columns that it counts by, and no text.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/*.parquet")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def add(batch: DataFrame, epoch: int) -> None:
        if len(fs.globStatus(where) or []):
            existing = spark.read.parquet(path).filter(F.col("epoch") != epoch)
        else:  # no table before the first batch
            existing = batch.limit(0).withColumn("front_key", digest("front"))
        new = integrate(existing.select("front_key", "collection", "category"), batch, dimension, fallback, go_on=True, key="front_key")
        new.withColumn("front_key", digest("norm_front")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return add


def upsert_stream(source: DataFrame, path: str, checkpoint: str, dimension: DataFrame, fallback: str):
    """A started query that ingests what is there and ends."""
    add = add_batch(source.sparkSession, path, dimension, fallback)
    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_states(state: DataFrame, cycles: DataFrame, budget: int = 40) -> DataFrame:
    """Stored page states with the outcomes of a batch of cycles (doc, image, outcome, text): rows without a cycle stay. A cycle is told by (doc, image, attempt), so one that comes twice counts once."""
    once = cycles.groupBy("doc", "image").agg(F.max_by(F.struct("outcome", "text"), "attempt").alias("_c"), F.max("attempt").alias("_at"))
    rows = state.join(once, ["doc", "image"], "left")
    moved = next_state(rows.filter(F.col("_c").isNotNull() & (F.col("_at") > F.col("attempts_used"))).withColumn("outcome", F.col("_c.outcome")), budget).withColumn("text", F.coalesce("_c.text", "text"))
    still = rows.filter(F.col("_c").isNull() | (F.col("_at") <= F.col("attempts_used")))
    return moved.select(*state.columns).unionByName(still.select(*state.columns))
