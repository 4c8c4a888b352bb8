"""Turns: extraction from captured exchanges, usability, signals, hashes.

All native: JSON is parsed by the JVM, arrays are handled by higher-order functions, and nothing shuffles but the keep-first rules.
Null or unparsable JSON gives null turns; such rows are dropped by ``extract_turns`` and counted by ``disposition``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnmill.functions import native as N
from turnmill.functions import patterns as P

REQUEST = f"struct<messages:{N.TURNS},prompt:string>"
RESPONSE = "struct<choices:array<struct<message:struct<content:string>>>,message:struct<content:string>,response:string>"


def parsed(json: Column, schema: str) -> Column:
    """The value, or null if the text is no JSON as a whole."""
    return F.when(F.try_parse_json(json).isNotNull(), F.from_json(json, schema))


def publishable(turns: Column) -> Column:
    """User and assistant turns with content."""
    return F.filter(turns, lambda t: t["role"].isin("user", "assistant") & (F.coalesce(t["content"], F.lit("")) != ""))


def _with_answer(turns: Column, answer: Column) -> Column:
    said = F.struct(F.lit("assistant").alias("role"), answer.alias("content"))
    return F.when(turns.isNotNull() & (F.coalesce(answer, F.lit("")) != ""), F.concat(turns, F.array(said)))


def extracted(request: Column, response: Column) -> Column:
    """Turns of the first shape that fits (messages + choices, messages + message, prompt + response), or null."""
    rq, rs = parsed(request, REQUEST), parsed(response, RESPONSE)
    asked = F.when(F.coalesce(rq["prompt"], F.lit("")) != "", F.array(F.struct(F.lit("user").alias("role"), rq["prompt"].alias("content"))))
    turns = F.coalesce(
        _with_answer(rq["messages"], F.get(rs["choices"], F.lit(0))["message"]["content"]),
        _with_answer(rq["messages"], rs["message"]["content"]),
        _with_answer(asked, rs["response"]),
    )
    return publishable(turns)


def extract_turns(exchanges: DataFrame) -> DataFrame:
    """exchanges with ``turns``; rows that fit no shape are left out."""
    return exchanges.withColumn("turns", extracted(F.col("request_json"), F.col("response_json"))).where("turns is not null")


def to_exchange(turns: Column) -> Column:
    """Turns that end in an answer: one trailing turn that is none is dropped; null if under two remain or the last is still none."""
    kept = publishable(turns)
    last = F.element_at(kept, -1)["role"]
    cut = F.when((F.size(kept) >= 2) & (last != "assistant"), F.slice(kept, F.lit(1), F.size(kept) - 1)).when(F.size(kept) >= 2, kept)
    return F.when((F.size(cut) >= 2) & (F.element_at(cut, -1)["role"] == "assistant"), cut)


def total_length(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0), lambda a, t: a + F.coalesce(F.length(t["content"]), F.lit(0)))


def joined(turns: Column) -> Column:
    """Contents joined by a space."""
    return F.array_join(F.transform(turns, lambda t: F.coalesce(t["content"], F.lit(""))), " ")


def signals(turns: Column) -> Column:
    """The quality signals of turns; the diversity as distinct and all words, so that no rounding is lost."""
    of = lambda role: F.filter(turns, lambda t: t["role"] == role)
    answers = of("assistant")
    w = N.words(joined(turns))
    avg = F.when(F.size(answers) == 0, F.lit(0)).otherwise(F.bround(total_length(answers) / F.size(answers), 0)).cast("long")
    return F.struct(
        avg.alias("avg_response_len"), joined(turns).rlike(P.CODE_BLOCK).alias("has_code"), F.size(F.array_distinct(w)).alias("distinct_words"), F.size(w).alias("words"),
        total_length(turns).alias("total_length"), F.size(of("user")).alias("user_msg_count"), F.size(answers).alias("assistant_msg_count"),
    )


def canonical(turns: Column) -> Column:
    """One text for the turns, roles and contents apart, as JSON, so that no content can imitate a boundary; null if the turns are."""
    return F.to_json(F.transform(turns, lambda t: F.array(F.coalesce(t["role"], F.lit("")), F.coalesce(t["content"], F.lit("")))))


def content_hash(turns: Column) -> Column:
    return F.sha2(canonical(turns), 256)


def keep_first(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; rows with a null key are never duplicates.

    min_by would lose ties and columns, a window sorts whole hot groups; so the least order key is found by a partial aggregate and joined back.
    """
    keys = [key] if isinstance(key, str) else key
    known = df.dropna(subset=keys)
    first = F.struct(*order).alias("_first")
    best = known.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_best"))
    kept = known.withColumn("_first", first).join(best, keys).where("_first = _best").drop("_first", "_best")
    return kept.unionByName(df.where(" or ".join(f"{k} is null" for k in keys)).select(kept.columns))


def first_appearance(df: DataFrame, text_id: str, key: str, start: str) -> DataFrame:
    """Numbers the distinct keys of each text, from 1, in the order in which they first appear."""
    first = df.groupBy(text_id, key).agg(F.min(start).alias("first_start"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(text_id).orderBy("first_start", key)))
