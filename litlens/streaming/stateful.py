"""Resumable ingest with keyed upserts, late rows, and counters kept per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litlens.streaming.windows import run_append


class IngestLog:
    """A table that grows by batches: each batch is one folder, written whole; a batch that is sent again replaces its own
    folder. Reading takes the newest row of each key, so an upsert never rewrites what lies there. compact() joins the folders."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def put(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/table/batch={batch_id:09d}")

    def read(self) -> DataFrame:
        w = Window.partitionBy(self.key).orderBy(F.desc("batch"), F.desc("_order"))
        rows = self.spark.read.option("basePath", f"{self.folder}/table").parquet(f"{self.folder}/table/batch=*")
        return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "batch", "_order")

    def ingest(self, stream: DataFrame, order: str) -> None:
        """Takes what has come since the last run and stops; the checkpoint beside the table says what was taken."""
        w = Window.partitionBy(self.key).orderBy(F.desc("_order"))
        last = lambda df: df.withColumn("_order", F.col(order)).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
        q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(lambda df, i: self.put(last(df), i)).start()
        q.awaitTermination()

    def compact(self, folder: str) -> "IngestLog":
        """The same rows as one batch of a new table."""
        new = IngestLog(self.spark, folder, self.key)
        new.put(self.read().withColumn("_order", F.lit(0)), 0)
        return new


def windows_in_time(stream: DataFrame, ts: str, every: str, late: str) -> DataFrame:
    """(start, n) of tumbling windows; rows that come behind the watermark for their window are dropped, and a window is given
    out once, when the watermark has passed it."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return run_append(g.select(F.col("w.start").alias("start"), "n"))


def due(stream: DataFrame, key: str, every: int) -> DataFrame:
    """(key, due): how often each key has come to `every` rows since it was due last; one number of state a key."""

    def count(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (have,) = state.get if state.exists else (0,)
        have += sum(len(f) for f in frames)
        state.update((have % every,))
        if have >= every:
            yield pd.DataFrame({key: [k[0]], "due": [have // every]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, due bigint", "n bigint", "append", "NoTimeout")
