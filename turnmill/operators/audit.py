"""Leak scan and over-redaction of records, native. Null texts count as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import native as N
from turnmill.functions import patterns as P

MOST = 3


def leaks(text: Column) -> Column:
    """Kind -> its first MOST finds; kinds without finds are left out. Octets of IPs are at most 255, and addresses of no machine don't count."""
    found = {}
    for kind, p in P.AUDIT.items():
        hits = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        if kind == "ip_address":
            hits = F.filter(hits, lambda m: F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255) & ~m.rlike(r"^(?:0|1\.0|2\.0|127)\."))
        if kind == "private_key":
            hits = F.filter(hits, lambda m: m != "")
        found[kind] = F.slice(hits, 1, MOST)
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in found.items()))
    return F.map_from_entries(F.filter(pairs, lambda e: F.size(e["value"]) > 0))


def placeholders(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(P.PLACEHOLDER), F.lit(0)))


def audit(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word_count, placeholder_count, density, preview, leaks)."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.select(key, t.alias("_t"), F.size(N.words(t)).alias("word_count"), placeholders(t).alias("placeholder_count"))
    return base.select(key, "word_count", "placeholder_count", (F.col("placeholder_count") / F.greatest("word_count", F.lit(1))).alias("density"), F.substring("_t", 1, 60).alias("preview"), leaks(F.col("_t")).alias("leaks"))


def rollup(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count("*").alias("total"), F.count_if(F.size("leaks") > 0).alias("leak_count"), F.count_if(F.col("density") > P.HIGH_DENSITY).alias("high_density"))


def leak_report(audited: DataFrame, key: str) -> DataFrame:
    """(key, kind, examples, preview): a row a record and kind of leak."""
    return audited.select(key, F.explode("leaks").alias("kind", "hits"), "preview").select(key, "kind", F.array_join("hits", ", ").alias("examples"), F.substring("preview", 1, 40).alias("preview"))


def density_report(audited: DataFrame, key: str, over: float = P.HIGH_DENSITY) -> DataFrame:
    """Records with more placeholders than a share of their words, the densest first."""
    return audited.where(F.col("density") > over).orderBy(F.desc("density"), key)
