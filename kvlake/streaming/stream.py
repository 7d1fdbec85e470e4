"""Structured Streaming adapters: upserts, transactions as they complete, windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kvlake.functions import exprs as X
from kvlake.operators import reads

#: Consecutive transactions that share a state.
TOGETHER = 256


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream."""
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return source.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return source.parquet(path)


def upsert(stream: DataFrame, out: str, checkpoint: str):
    """Each batch's newest version of each key, in a folder of its own, which a retry overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        reads.latest(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of each key over all batches."""
    return reads.latest(spark.read.parquet(out).drop("batch"))


def assemble(log: DataFrame) -> DataFrame:
    """Rows of transactions whose end marker has come: state holds a transaction's rows until then, and after it only that it ended.

    Rows and markers may come in any order. TOGETHER consecutive transactions share a state and a call,
    as a call's own time is many times a row's; a batch opens only the states that its rows belong to.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended, *columns = state.get if state.exists else ([], [], [], [])
        ended, parts = [np.array(ended, "int64")], [[np.array(c, kind) for c, kind in zip(columns, ("int64", "int64", object))]]
        for pdf in batches:
            kind = pdf["kind"].to_numpy()
            ended.append(pdf["ts"].to_numpy()[kind == "F"])
            parts.append([pdf[c].to_numpy()[kind == "T"] for c in ("ts", "seq", "key")])
        ended, rows = np.unique(np.concatenate(ended)), [np.concatenate(c) for c in zip(*parts)]
        done = np.isin(rows[0], ended)
        state.update((ended.tolist(), *(c[~done].tolist() for c in rows)))
        if done.any():
            yield pd.DataFrame({name: c[done] for name, c in zip(("ts", "seq", "key"), rows)})

    grouped = log.where("ts is not null").withColumn("_together", F.expr(f"ts div {TOGETHER}")).groupBy("_together")
    return grouped.applyInPandasWithState(step, "ts long, seq long, key string", "ended array<long>, ts array<long>, seqs array<long>, keys array<string>", "append", GroupStateTimeout.NoTimeout)


def append_to(df: DataFrame, out: str, checkpoint: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour (epoch seconds of its start) and type; rows later than the watermark are dropped."""
    timed = stream.withColumn("at", F.timestamp_seconds(X.epoch_seconds("ts"))).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("long").alias("start"), "event_type", "n")
