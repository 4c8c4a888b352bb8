"""Streams: windows with watermarks, dedup with a lifetime, capture and tier decay.

Rows later than the watermark are dropped; the watermark of each rule is its lifetime. All work with Trigger.AvailableNow, whose result equals the batch forms'.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions.native import captured_path


def counts(stream: DataFrame, ts: str, size: str, lateness: str, *keys: str) -> DataFrame:
    """Rows a window and key."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("window_start"), "n")


def first_within(stream: DataFrame, keys: list[str], ts: str, lifetime: str = "30 days") -> DataFrame:
    return stream.withWatermark(ts, lifetime).dropDuplicatesWithinWatermark(keys)


def captures(stream: DataFrame) -> DataFrame:
    """Captured traffic: (path, status, ...) of successful calls to the captured endpoints."""
    return stream.where(captured_path(F.col("path")) & F.col("status").between(200, 299))


def tiers(stream: DataFrame, key: str, violation: str, start: int = 3) -> DataFrame:
    """(key, tier) whenever a key's tier changes; its state is one number. Any violation resets the tier to 1."""

    def update(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tier = state.get[0] if state.exists else start
        new = 1 if tier == 1 or any(bool(p[violation].any()) for p in parts) else tier
        if not state.exists or new != tier:
            state.update((new,))
            yield pd.DataFrame({key: [k[0]], "tier": [new]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, tier int", "tier int", "append", "NoTimeout")


def run(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is available, into parquet, and reads the result."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(folder)


def run_updates(stream: DataFrame, folder: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Runs the stream in update mode over what is available. Each micro-batch writes its rows under its number, so that a repeated one overwrites itself; read are, of each of the keys, the last."""
    q = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/batch={i}")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark: SparkSession = stream.sparkSession
    rest = [c for c in stream.columns if c not in keys]
    read = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in stream.dtypes)}, batch long").option("basePath", folder).parquet(folder)
    return read.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of new files of a folder, as they come."""
    return spark.readStream.text(folder)
