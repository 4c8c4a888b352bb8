"""Raw exchanges to staged records: extraction, least length, content filter, language of the raw turns, scrubbing, signals of the scrubbed turns.

One pass, no shuffle: every exchange gets a disposition, and what is staged, skipped and counted are views of that table. Each of several stages in Python
works on a whole conversation, so nothing is taken apart and joined again. Where the reference aborts a batch when its content filter fails, the task fails here;
an exchange whose turns can't be extracted or scrubbed is skipped.

Results: every row of ``raw`` exchanges once; null or unparsable JSON is ``unparsed``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import native as N
from turnmill.functions import patterns as P
from turnmill.functions import scrub as S
from turnmill.functions.lang import Backend, language
from turnmill.operators import turns as T


def dispositions(exchanges: DataFrame, rules: S.Blocklist | None = None, filter_: Column | None = None) -> DataFrame:
    """exchanges with ``turns`` and ``reason``: unparsed, short, blocked:<category>, or null for those to be staged.

    ``filter_``: a filter of one's own over the column ``texts`` (an array), by default the blocklist; see ``composite``.
    """
    t = exchanges.withColumn("turns", T.extracted(F.col("request_json"), F.col("response_json")))
    early = F.when(F.col("turns").isNull(), "unparsed").when(T.total_length(F.col("turns")) < P.MIN_CHARS, "short")
    t = t.withColumn("reason", early)
    # only what is still in the run is filtered
    t = t.withColumn("texts", F.when(F.col("reason").isNull(), F.transform("turns", lambda x: x["content"])))
    blocked = filter_ if filter_ is not None else S.check_all_udf(rules or S.Blocklist.load())(F.col("texts"))
    return t.withColumn("reason", F.coalesce("reason", F.concat(F.lit("blocked:"), blocked)))


def composite(*checks: Column) -> Column:
    """Several content filters in order: the first category wins."""
    return F.coalesce(*checks)


def content_filter(texts: Column, rules: S.Blocklist | None = None, scores: dict[str, Column] | None = None) -> Column:
    """The filter to use: the blocklist first, then, where scores of a model are there, the ladder of thresholds."""
    listed = S.check_all_udf(rules or S.Blocklist.load())(texts)
    return listed if not scores else composite(listed, N.ladder(scores))


def process(exchanges: DataFrame, rules: S.Blocklist | None = None, backend: Backend | None = None, has_ner: bool = False, filter_: Column | None = None) -> DataFrame:
    """exchanges (of status raw) with ``disposition`` (processed or skipped), ``reason``, ``scrubbed_turns``, ``turn_count``, ``language``, ``quality_signals`` and ``ner_scrubbed``."""
    d = dispositions(exchanges.where("status = 'raw'"), rules, filter_)
    ok = F.col("reason").isNull()
    d = d.withColumn("language", F.when(ok, language(T.joined(F.col("turns")), backend)))
    d = d.withColumn("_clean", S.scrub_all_udf(F.when(ok, F.col("texts"))))
    d = d.withColumn("_turns", F.when(ok, F.zip_with("turns", "_clean", lambda a, c: F.struct(a["role"].alias("role"), c.alias("content")))))
    q = T.signals(F.col("_turns"))
    diversity = F.when(q["words"] == 0, 0.0).otherwise(F.round(q["distinct_words"] / q["words"], 3))
    signals = F.struct(q["avg_response_len"].alias("avg_response_len"), q["has_code"].alias("has_code"), diversity.alias("vocab_diversity"), q["total_length"].alias("total_length"), q["user_msg_count"].alias("user_msg_count"), q["assistant_msg_count"].alias("assistant_msg_count"))
    return d.select(
        *exchanges.columns, F.when(ok, "processed").otherwise("skipped").alias("disposition"), "reason", F.to_json("_turns").alias("scrubbed_turns"),
        F.when(ok, F.size("turns")).alias("turn_count"), "language", F.when(ok, F.to_json(signals)).alias("quality_signals"), F.when(ok, F.lit(int(has_ner))).alias("ner_scrubbed"),
    )


def staged(processed: DataFrame) -> DataFrame:
    """New staged records; their ids follow from the exchanges', so that a repeated run gives the same."""
    key = F.md5(F.concat_ws("|", F.lit("staged"), "id", F.coalesce(F.col("received_at").cast("string"), F.lit(""))))
    return processed.where("disposition = 'processed'").select(
        N.as_uuid(key).alias("id"), F.col("id").alias("exchange_id"), F.current_timestamp().alias("created_at"), "scrubbed_turns", F.lit(0).alias("approved"), F.lit(0).alias("uploaded"), F.lit(0).alias("fail_count"),
        "ner_scrubbed", "turn_count", "language", "quality_signals",
    )


def marked(exchanges: DataFrame, processed: DataFrame) -> DataFrame:
    """exchanges with the status that the run leaves: rows that were raw become processed or skipped. A redelivered id is processed if one of its rows was."""
    new = processed.where("id is not null").groupBy("id").agg(F.min("disposition").alias("_new"))
    j = exchanges.join(new, "id", "left")
    return j.withColumn("status", F.when((F.col("status") == "raw") & F.col("_new").isNotNull(), F.col("_new")).when((F.col("status") == "raw") & F.col("id").isNull(), F.lit("skipped")).otherwise(F.col("status"))).select(exchanges.columns)
