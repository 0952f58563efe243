"""Windowed counts with a watermark, sessions, and a sink that repeats nothing."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolake.sources.storage import place, shared_dir


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event file as a stream; its folder is watched for files of that name."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    # Watermarks need a time with a zone; the session's is as good as any for times without one.
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling window; rows later than the watermark are left out by the stream."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n) by session window."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def run_once(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through the stream, as a table in memory: for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_written(df: DataFrame, tag: str) -> DataFrame:
    """All that is there now, through the stream, written by the executors: each batch's whole result replaces the last one."""
    spark = df.sparkSession
    path, log = place(spark, tag), place(spark, f"{tag}-log")
    # Without any file there is no batch, and the result is this.
    spark.createDataFrame([], df.schema).write.parquet(path)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def append_once(df: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key is not in path yet: a batch that is delivered again adds nothing."""
    spark = df.sparkSession

    def put(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key])
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    # The same folder for the same path in every process, so that a stream goes on where it was.
    checkpoint = os.path.join(shared_dir(spark), f"stream-{hashlib.md5(path.encode()).hexdigest()}")
    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
