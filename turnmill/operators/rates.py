"""Window and lifetime rules in batch form; streaming/windows.py has them as streams.

Counts are windowed aggregates (partial before the shuffle, so hot keys don't gather rows); rules that look at the row before use a
window function over a key. Null keys form a group of their own; null times belong to no window and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnmill.functions import patterns as P
from turnmill.session import small


def windowed(df: DataFrame, ts: str, unit: str, *keys: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(*keys, F.date_trunc(unit, F.col(ts).cast("timestamp")).cast("timestamp_ntz").alias("window_start")).agg(F.count("*").alias("n"))


def over_limit(counts: DataFrame, limit: Column | int) -> DataFrame:
    lim = F.lit(limit) if isinstance(limit, int) else limit
    return counts.withColumn("allowed", F.least(F.col("n"), lim)).withColumn("rejected", F.greatest(F.col("n") - lim, F.lit(0)))


def tier_limit(tier: Column) -> Column:
    """Uploads an hour: a missing tier counts as 3, an unknown one as the least."""
    t = F.coalesce(tier, F.lit(3))
    return F.when(t == 1, P.HOURLY_BY_TIER[1]).when(t == 2, P.HOURLY_BY_TIER[2]).when(t == 3, P.HOURLY_BY_TIER[3]).otherwise(min(P.HOURLY_BY_TIER.values()))


def cooldown(df: DataFrame, key: str, ts: str, hours: int = 1) -> DataFrame:
    """Whether each row falls into the first hours after its key's first row."""
    first = small(df.groupBy(F.col(key).alias("_key")).agg(F.min(ts).alias("_first")))
    return df.join(first, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn("cooling", F.col(ts) < F.col("_first") + F.expr(f"interval {hours} hours")).drop("_first")


#: Seconds after which a repeated upload, a contribution and a device code are forgotten.
UPLOAD_TTL, CONTRIBUTION_TTL, DEVICE_TTL = 30 * 86400, 90 * 86400, 600


def ttl_first(df: DataFrame, keys: list[str], ts: str, order: str, seconds: int = UPLOAD_TTL) -> DataFrame:
    """Rows with no row of the same keys in the seconds before: the previous row decides.

    A key is cut into days, so that a hot key is sorted by many tasks: within a day the row before is next to it, and before
    a day's first row comes the last row of the key's last day, which a small table of (key, day) has. Null keys are equal to each other.
    """
    day = df.withColumn("_day", F.to_date(ts))
    last = day.groupBy(*keys, "_day").agg(F.max(ts).alias("_max"))
    last = last.withColumn("_before", F.lag("_max").over(Window.partitionBy(*keys).orderBy("_day"))).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_day").alias("_d"), "_before")
    same = F.col("_day").eqNullSafe(F.col("_d"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    j = day.join(last, same)
    prev = F.coalesce(F.lag(ts).over(Window.partitionBy(*keys, "_day").orderBy(ts, order)), F.col("_before"))
    return j.withColumn("_prev", prev).where(F.col("_prev").isNull() | (F.col(ts) > F.col("_prev") + F.expr(f"interval {seconds} seconds"))).select(df.columns)


def registrations(df: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """``outcome`` of each attempt to register: flood beyond REGISTER_MINUTE a key and minute, limited beyond REGISTER_DAY (of those that were no flood) a key and day, else ok. Null keys form one key.

    Attempts are numbered within a key and minute, and the days from the minutes' counts, so that no key is sorted for longer than a minute.
    """
    d = df.withColumn("_minute", F.date_trunc("minute", ts)).withColumn("_day", F.date_trunc("day", ts))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_minute").orderBy(ts, order)))
    per = d.groupBy(F.col(key).alias("_k"), F.col("_day").alias("_d"), F.col("_minute").alias("_m")).agg(F.least(F.count("*"), F.lit(P.REGISTER_MINUTE)).alias("_passed"))
    before = F.coalesce(F.sum("_passed").over(Window.partitionBy("_k", "_d").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = d.join(per.withColumn("_before", before), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_minute") == F.col("_m")))
    out = F.when(F.col("_n") > P.REGISTER_MINUTE, "flood").when(F.col("_before") + F.col("_n") > P.REGISTER_DAY, "limited").otherwise("ok")
    return j.withColumn("outcome", out).select(*df.columns, "outcome")


def decay(events: DataFrame, key: str, violation: Column, start: int = 3) -> DataFrame:
    """Tier of each key: reset to 1 by any violation, else the start."""
    return events.groupBy(key).agg(F.max(violation.cast("int")).alias("_v"), F.sum(violation.cast("int")).alias("violations")).select(key, F.when(F.col("_v") == 1, 1).otherwise(start).alias("tier"), "violations")


#: Status of an upload by the gate that stops it, in the order of the gates.
GATES = {"too_large": 413, "auth": 401, "cooldown": 429, "minute": 429, "hour": 429, "duplicate": 409, "invalid": 422, "ner": 503, "ok": 200}
#: Counters of the service, with the gate that each counts.
COUNTERS = {"uploads_total": "ok", "auth_failures_total": "auth", "validation_errors_total": "invalid", "ner_errors_total": "ner", "dedup_blocks_total": "duplicate", "cooldown_blocks_total": "cooldown", "global_rate_limited_total": "minute"}


def upload_gate(size: Column, known: Column, age_s: Column, minute_n: Column, hour_n: Column, limit: Column, duplicate: Column, valid: Column, ner: Column) -> Column:
    """The first gate that stops an upload, else ok."""
    return (
        F.when(size > 2 * 1024 * 1024, "too_large").when(~known, "auth").when(age_s < 3600, "cooldown").when(minute_n > P.MINUTE_LIMIT, "minute").when(hour_n > limit, "hour")
        .when(duplicate, "duplicate").when(~valid, "invalid").when(~ner, "ner").otherwise("ok")
    )


def status_of(gate: Column) -> Column:
    return F.coalesce(*(F.when(gate == g, code) for g, code in GATES.items()))


def counters(gated: DataFrame, gate: str = "gate") -> DataFrame:
    """(metric, value): all counters and how many uploads failed, one partial aggregate."""
    n = gated.agg(*(F.count_if(F.col(gate) == g).alias(name) for name, g in COUNTERS.items()), F.count_if(F.col(gate) != "ok").alias("uploads_failed"))
    pairs = ", ".join(f"'{c}', {c}" for c in n.columns)
    return n.selectExpr(f"stack({len(n.columns)}, {pairs}) as (metric, value)")
