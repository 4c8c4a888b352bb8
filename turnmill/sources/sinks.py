"""Writers and readers of published batches: newline-delimited JSON, gzip, a folder a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The least gzip level, the largest upload, and how batches are named.
GZIP_LEVEL, MOST_BYTES = "BEST_SPEED", 2 * 1024 * 1024
BATCH_PATH = r"^data/batch_\d{4}-\d{2}-\d{2}_[a-z0-9]+\.jsonl$"


def write_batches(records: DataFrame, path: str, day: Column | str) -> None:
    """Records as gzipped JSON lines below path/date=...; many tasks may write a day, so a hot day is no bottleneck. The level is a setting of the session's Hadoop configuration, not of the writer."""
    d = F.to_date(F.col(day) if isinstance(day, str) else day).alias("date")
    records.withColumn("date", d).write.mode("append").partitionBy("date").option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).option("ignoreNullFields", "false").json(path)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of uploaded files, plain or gzipped, that are no larger than an upload may be, as sent and as inflated."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_path")).withColumn("_sent", F.col("_metadata.file_size"))
    fit = files.where((F.col("_sent") <= MOST_BYTES) & (F.octet_length("value") <= MOST_BYTES))
    lines = fit.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "")


def payload_hash(text: Column) -> Column:
    """Hash of a trimmed upload, by which repeated ones are told."""
    return F.sha2(F.trim(text), 256)


def purge_batches(index: DataFrame, wanted: DataFrame, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """(index without the wanted files, wanted files with ``deleted``): only well-formed batch paths are deleted."""
    valid = wanted.select(file).distinct().withColumn("deleted", F.coalesce(F.col(file).rlike(BATCH_PATH), F.lit(False)))
    return index.join(valid.where("deleted").select(file), file, "left_anti"), valid
