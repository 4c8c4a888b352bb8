"""From exports to exchanges: usability, keep-first on the content hash, and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import native as N
from turnmill.operators import turns as T


def classified(conversations: DataFrame) -> DataFrame:
    """Adds ``exchange`` (turns that end in an answer), ``content_hash`` (over all parsed turns) and ``outcome``: malformed, empty, duplicate or imported. The first of equal ones counts, by file and conv_no."""
    c = conversations.withColumn("exchange", T.to_exchange(F.col("turns"))).withColumn("content_hash", T.content_hash(F.col("turns")))
    usable = c.where("exchange is not null").groupBy("content_hash").agg(F.min(F.struct("file", "conv_no")).alias("_first"))
    j = c.join(usable, "content_hash", "left")
    outcome = F.when(F.col("turns").isNull(), "malformed").when(F.col("exchange").isNull(), "empty").when(F.struct("file", "conv_no") != F.col("_first"), "duplicate").otherwise("imported")
    return j.withColumn("outcome", outcome).drop("_first")


def new_only(classified_: DataFrame, store: DataFrame) -> DataFrame:
    """Imported rows whose hash the store doesn't have."""
    return classified_.where("outcome = 'imported'").join(store.select("content_hash").where("content_hash is not null").distinct(), "content_hash", "left_anti")


def statistics(classified_: DataFrame, *by: str) -> DataFrame:
    n = lambda x: F.count_if(F.col("outcome") == x)
    return classified_.groupBy(*by).agg(n("imported").alias("imported"), n("empty").alias("skipped_empty"), n("duplicate").alias("skipped_duplicate"), n("malformed").alias("skipped_malformed"))


@dataclass(frozen=True)
class Imported:
    """exchanges: what is new (None in a dry run); statistics: a row a file; errors: (file, error) of files and conversations that could not be read."""

    exchanges: DataFrame | None
    statistics: DataFrame
    errors: DataFrame


def import_exports(spark: SparkSession, paths: list[str], store: DataFrame | None = None, dry_run: bool = False) -> Imported:
    """Reads exports of any known format into exchanges. What the store has already counts as duplicate; each file is a session of its own. A path of no known format is an error, not an end.

    A dry run gives the same statistics and no exchanges.
    """
    from turnmill.sources.formats import SCHEMA, read_export

    parts, failed = [spark.createDataFrame([], SCHEMA)], []
    for path in paths:
        try:
            parts.append(read_export(spark, path))
        except (ValueError, OSError) as e:
            failed.append((path, str(e)))
    conversations = parts[0]
    for p in parts[1:]:
        conversations = conversations.unionByName(p)
    c = classified(conversations)
    if store is not None:
        known = store.where("content_hash is not null").select("content_hash").distinct().withColumn("_known", F.lit(True))
        c = c.join(known, "content_hash", "left").withColumn("outcome", F.when((F.col("outcome") == "imported") & F.col("_known"), "duplicate").otherwise(F.col("outcome"))).drop("_known")
    errors = spark.createDataFrame(failed, "file string, error string").unionByName(c.where("error is not null").select("file", "error"))
    new = None
    if not dry_run:
        turns = F.col("exchange")
        request = F.to_json(F.struct(F.slice(turns, F.lit(1), F.size(turns) - 1).alias("messages")))
        response = F.to_json(F.struct(F.array(F.struct(F.element_at(turns, -1).alias("message"))).alias("choices")))
        new = c.where("outcome = 'imported'").select(
            N.as_uuid(F.md5(F.concat(F.lit("import|"), "content_hash"))).alias("id"), F.concat(F.lit("import-"), N.as_uuid(F.md5("file"))).alias("session_id"), F.current_timestamp().alias("created_at"),
            request.alias("request_json"), response.alias("response_json"), F.lit("raw").alias("status"), "content_hash",
        )
    return Imported(new, statistics(c, "file"), errors)
