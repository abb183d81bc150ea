"""Distinct counts over sliding windows of a stream, exact and by the Flajolet-Martin sketch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.sketch import COUNT_HASHES, fm_distinct, fm_estimate, fm_rank_columns
from tessera.streaming.sinks import appending

HEADER = "Time,Ground Truth,Estimation\n"  # Fixed value: the first line of the file


def sliding_distinct(events: DataFrame, time: str, column: str, length: str = "30 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(window, distinct, estimate) per window, for streams and tables alike.

    On a stream, values are made distinct within each window by a first stateful operator and
    counted by a second; a window comes out once the watermark has passed its end, and rows later
    than ``late`` are left out. State is one row per window and value, and 61 numbers per window.
    """
    timed = events.withColumn("__time", F.col(time).cast("timestamp")).filter(F.col(column).isNotNull())
    if not events.isStreaming:
        return fm_distinct(timed, [F.window("__time", length, slide).alias("window")], column)
    timed = timed.withWatermark("__time", late)
    values = timed.select(F.window("__time", length, slide).alias("window"), F.col(column).alias("value")).dropDuplicates(["window", "value"])
    hashed = values.select("window", fm_rank_columns(F.col("value")).alias("z"))
    n = len(COUNT_HASHES)
    largest = hashed.groupBy("window").agg(F.count("*").alias("distinct"), *[F.max(F.col("z")[i]).alias(f"r{i}") for i in range(n)])
    return largest.select("window", "distinct", F.round(fm_estimate([F.col(f"r{i}") for i in range(n)]), 6).alias("estimate"))


def append_csv(windows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends ``time,exact,estimate`` rows to a file, its header first; a micro-batch without windows adds nothing.

    A restart from the checkpoint goes on with the file; a batch that is tried again replaces its first try.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.orderBy("window").select(F.date_format(F.col("window.end"), "yyyy-MM-dd HH:mm:ss").alias("t"), "distinct", "estimate").collect()
        with appending(path, number, HEADER) as f:
            f.writelines(f"{r['t']},{r['distinct']},{r['estimate']}\n" for r in rows)

    return windows.writeStream.foreachBatch(write).option("checkpointLocation", os.fspath(checkpoint)).outputMode("append").trigger(**(trigger or {"processingTime": "5 seconds"})).start()
