"""Incremental forms of ingestion and counting (L). A run takes all files that are there, commits its offsets and stops;
the next run with the same checkpoint folder goes on from there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.operators import tables as T
from litlens.operators.tables import shared_folder


def events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The event files under a path as a stream, `files` of them a batch; as a pattern, a single file is a source as well as a
    folder is."""
    pattern = f"{path[:-1]}[{path[-1]}]"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    return (source.option("maxFilesPerTrigger", files) if files else source).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def run_merged(result: DataFrame, keys: list[str], folder: str | None = None, progress: list | None = None) -> DataFrame:
    """Runs a stream in update mode to the end of its input and returns what it last said of each key. A batch merges its rows
    into the table of the one before and writes the whole as its own folder, so a repeated batch changes nothing, and the state
    of keys that the watermark has passed can go. A row with n = 0 takes its key back. progress gets the batches' reports."""
    spark = result.sparkSession
    root = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def versions() -> list[int]:
        fs, at, _ = T._fs(spark, f"{root}/result")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at)) if fs.exists(at) else []

    def put(df: DataFrame, batch: int) -> None:
        session = df.sparkSession
        before = [v for v in versions() if v < batch]
        rows = df.persist()
        if before:
            old = session.read.schema(result.schema).parquet(f"{root}/result/{before[-1]}")
            rows = old.join(df.select(*keys), keys, "left_anti").select(*result.columns).unionByName(df)
        rows.filter("n > 0").write.mode("overwrite").parquet(f"{root}/result/{batch}")
        df.unpersist()
        for v in before[:-1]:  # the last one stays until this batch is committed
            fs, at, _ = T._fs(spark, f"{root}/result/{v}")
            fs.delete(at, True)

    q = result.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(put).start()
    q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress
    done = versions()
    return spark.read.schema(result.schema).parquet(f"{root}/result/{done[-1]}") if done else spark.createDataFrame([], result.schema)


def run_append(result: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream without aggregation to the end of its input into Parquet files, each committed once."""
    spark = result.sparkSession
    root = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = result.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/result").start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{root}/result")


def day_counts(df: DataFrame, late: str = "2 days") -> DataFrame:
    """L3: tumbling days per type."""
    g = df.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("day"), "event_type", "n")


def activity(df: DataFrame, late: str = "2 days") -> DataFrame:
    """L4: seven days, sliding by one."""
    g = df.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("week"), "event_type", "n")


def sessions(df: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(user_id, start, n): sessions of each user, ended by a pause of `gap`. State is the sessions that an event could still
    reach; a session goes when the watermark has passed its end and its pause. Rows are updates: n = 0 takes back a session that
    another one has swallowed."""
    pause = pd.Timedelta(gap)

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        before = {a: n for a, _, n in held}
        found = sorted(held + [(t, t, 1) for f in frames for t in f["ts"].astype("int64").tolist()])
        now: list[tuple] = []
        for a, z, n in found:
            if now and a < now[-1][1] + pause.value:
                now[-1] = now[-1][0], max(now[-1][1], z), now[-1][2] + n
            else:
                now.append((a, z, n))
        after = {a: n for a, _, n in now}
        changed = [(a, n) for a, n in after.items() if before.get(a) != n] + [(a, 0) for a in before if a not in after]
        past = state.getCurrentWatermarkMs() * 1_000_000
        open_ = [x for x in now if x[1] + pause.value > past]
        if open_:
            state.update(tuple(list(x) for x in zip(*open_, strict=True)))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (min(z for _, z, _ in open_) + pause.value) // 1_000_000 + 1))
        elif state.exists:
            state.remove()
        if changed:
            yield pd.DataFrame({"user_id": key[0], "start": pd.to_datetime([a for a, _ in changed]), "n": [n for _, n in changed]})

    kind = df.schema["user_id"].dataType.simpleString()
    rows = df.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(grow, f"user_id {kind}, start timestamp, n bigint", "starts array<bigint>, ends array<bigint>, ns array<bigint>", "update", "EventTimeTimeout")


def distinct_events(df: DataFrame, keys: list[str], late: str = "60 days") -> DataFrame:
    """L2: the first arrival of each key within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
