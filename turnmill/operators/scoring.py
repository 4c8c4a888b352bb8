"""Scores of scanners on a labelled corpus: recall of sensitive values and over-redaction of guards.

Cases: id, input, sensitive array<struct<entity_type, entity_value, start_position, end_position>>, guard array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASE = "id string, input string, sensitive array<struct<entity_type:string,entity_value:string,start_position:int,end_position:int>>, guard array<string>"

# The patterns of the plain scanner that others are compared with.
PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b\d{3}[-.]\d{3}[-.]\d{4}\b",
    r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    r"sk-[A-Za-z0-9]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"ghp_[A-Za-z0-9]{36,}",
]


def plain_scrub(text: Column) -> Column:
    """What the plain scanner makes of a text."""
    for p in PLAIN:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


#: Types that a scanner answers for.
SCOPES = {"secret": "entity_type like 'secret/%'", "pii": "entity_type not like 'secret/%'", "all": "true"}


def score(cases: DataFrame, scrubbed: Column, scope: str = "all") -> DataFrame:
    """(hits, total, recall_pct, false_positives, guards, over_redaction_pct); scrubbed: what the scanner makes of input. A value is caught if it is gone; a case of guards only must stay as it is."""
    s = cases.withColumn("_out", scrubbed)
    spans = s.select("_out", F.explode("sensitive").alias("s")).select("_out", "s.*").where(SCOPES[scope])
    caught = spans.agg(F.count_if(~F.col("_out").contains(F.col("entity_value"))).alias("hits"), F.count("*").alias("total"))
    guards = s.where(F.size("guard") > 0).agg(F.count_if((F.size("sensitive") == 0) & (F.col("_out") != F.col("input")) | F.exists("guard", lambda g: ~F.col("_out").contains(g))).alias("false_positives"), F.count("*").alias("guards"))
    pct = lambda a, b: F.when(F.col(b) > 0, F.floor(100 * F.col(a) / F.col(b)))
    return caught.crossJoin(guards).withColumn("recall_pct", pct("hits", "total")).withColumn("over_redaction_pct", pct("false_positives", "guards"))


def overlaps(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """(id, sensitive index) covered by a finding (id, start, end): spans that overlap. An equi-join on the case, then the span condition."""
    spans = cases.select("id", F.posexplode("sensitive").alias("span", "s")).select("id", "span", "s.start_position", "s.end_position")
    return spans.join(findings, "id").where("start < end_position and start_position < end").select("id", "span").distinct()


def problems(cases: DataFrame) -> DataFrame:
    """(id, problem): offsets that don't give the value, guards that are not in the input, repeated ids."""
    s = cases.select("id", "input", F.explode("sensitive").alias("s"))
    off = s.where("substring(input, s.start_position + 1, s.end_position - s.start_position) <> s.entity_value").select("id", F.lit("offset").alias("problem"))
    guard = cases.select("id", "input", F.explode("guard").alias("g")).where(~F.col("input").contains(F.col("g"))).select("id", F.lit("guard").alias("problem"))
    twice = cases.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("problem"))
    return off.unionByName(guard).unionByName(twice).distinct()


def flag_rate(files: DataFrame, group: str, text: str, scrubbed: Column) -> DataFrame:
    """Per group: files, files changed at all, files with a [SECRET] that was not there before."""
    s = files.where(F.col(text).isNotNull()).withColumn("_out", scrubbed)
    new = F.col("_out").contains("[SECRET]") & ~F.col(text).contains("[SECRET]")
    return s.groupBy(group).agg(F.count("*").alias("files"), F.count_if(F.col("_out") != F.col(text)).alias("changed"), F.count_if(new).alias("with_secret"))
