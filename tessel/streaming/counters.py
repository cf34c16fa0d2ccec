"""Counters over streams. The saturating counter is state of a key; late rows of a batch are
ordered within it, and rows of a later batch count as later. Windowed counts with a watermark are an extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessel.shared import new_folder


def stream(spark: SparkSession, path: str, like: DataFrame, files: int = 64) -> DataFrame:
    """The files of a table as they come, so many a micro-batch at most. ``path`` is a folder of part files or a single file;
    Spark streams from folders only, so a single file is named by a glob that fits just it."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def saturating(events: DataFrame, key: str, ts: str, tie: str, step: str) -> DataFrame:
    """(key, counter): the counter after each batch that has rows of the key. Only a number is
    kept for each key. Columns: key bigint, ts timestamp, tie bigint, step int."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values([ts, tie])
        for s in rows[step].tolist():
            n = max(0, n + s)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "counter": [n]})

    return events.select(key, ts, tie, step).groupBy(key).applyInPandasWithState(fold, f"{key} bigint, counter bigint", "n bigint", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by window of event time; a window closes when the watermark has passed it."""
    counted = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n")


def drained(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now. What each batch tells is written by the tasks to the
    shared folder, with the column ``batch``, its number; a batch that is told again replaces
    itself. Without input the table is empty."""
    spark = df.sparkSession
    out = new_folder(spark, name)
    spark.createDataFrame([], df.schema).write.parquet(f"{out}/batch=-1")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = df.writeStream.foreachBatch(write).option("checkpointLocation", new_folder(spark, f"{name}-state")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
