"""Streams: the index kept up to date batch by batch, and windowed counts of events.

The windowed counts are an extension, not something the batch side has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.dedupe import latest_per_key
from lodestar.operators.index import Embedder, embedded


def indexed_stream(rows: DataFrame, path: str, checkpoint: str, make: Callable[[], Embedder], order: str | None = None) -> StreamingQuery:
    """Appends (id, text, hash, embedding, batch) for rows that differ from what their id holds now.

    A text that comes back after another one is a change too.  A null text
    takes the id out.  Of several rows of one id in a batch the last by
    ``order`` holds (nulls first; on a tie, and without ``order``, the greatest
    hash, where a null text counts as least).  A batch that is run again finds
    its rows in place and appends nothing, so the table is right after any
    failure; ``current_index`` gives what holds.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("hash", F.when(F.col("text").isNotNull(), F.col("hash")))
        last = [F.desc_nulls_last(order)] if order else []
        fresh = latest_per_key(fresh, ["id"], [*last, F.desc_nulls_last("hash")])
        fresh = fresh.drop(order) if order else fresh
        if _there(spark, path):
            now = _latest(spark, path).select(F.col("id").alias("id_now"), F.col("hash").alias("hash_now"))
            fresh = fresh.join(now, (F.col("id") == F.col("id_now")) & F.col("hash").eqNullSafe(F.col("hash_now")), "left_anti")
        rows = embedded(fresh, "text", make).withColumn("embedding", F.when(F.col("text").isNotNull(), F.col("embedding")))
        rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _latest(spark: SparkSession, path: str) -> DataFrame:
    return latest_per_key(spark.read.parquet(path), ["id"], [F.desc("batch"), F.asc_nulls_last("hash")])


def current_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows that hold: the latest of every id that was not taken out."""
    return _latest(spark, path).filter(F.col("text").isNotNull())


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts and sums by type; the watermark bounds the state."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count("*").alias("events"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "events", "total")
    )
