"""Records on their way to publication: states, leases, chunks, gates.

State is data: each transition is a function of the table and of decisions, and gives the new table; a snapshot is written as a
new version. Of several decisions for a record one counts; decisions for unknown records change nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import native as N
from turnmill.functions import patterns as P
from turnmill.functions import scrub as S
from turnmill.session import tasks, written

DEAD = 3


def pending(staged: DataFrame) -> DataFrame:
    return staged.where("approved = 0 and uploaded = 0")


def eligible(staged: DataFrame) -> DataFrame:
    return staged.where(f"approved = 1 and uploaded = 0 and fail_count < {DEAD}")


def dead(staged: DataFrame) -> DataFrame:
    return staged.where(f"fail_count >= {DEAD} and uploaded = 0")


def oldest(df: DataFrame, n: int) -> DataFrame:
    """The n oldest rows; ties by id."""
    return df.orderBy("created_at", "id").limit(n)


def audit_scope(staged: DataFrame, everything: bool = False) -> DataFrame:
    """Rows not uploaded; if there are none, the uploaded ones."""
    if everything:
        return staged
    waiting = staged.where("uploaded = 0")
    any_waiting = waiting.select(F.lit(1).alias("one")).limit(1)
    return waiting.unionByName(staged.where("uploaded = 1").join(any_waiting, F.lit(True), "left_anti"))


def _last(df: DataFrame, what: str, ranks: list[str], at: str | None) -> DataFrame:
    """(id, what): of several for an id the last by ``at``, of those at the same time (or without a time) the one that comes first in ranks."""
    rank = F.coalesce(*(F.when(F.col(what) == x, F.lit(-i)) for i, x in enumerate(ranks)), F.lit(-len(ranks)))
    return df.where("id is not null").groupBy("id").agg(F.max(F.struct(*([at] if at else []), rank.alias("_rank"), what))[what].alias(what))


def decide(staged: DataFrame, decisions: DataFrame, at: str | None = None) -> DataFrame:
    """Decisions (id, action): approve and unapprove set the flag, reject deletes, retry clears the failures. Of several the last by ``at`` counts, else the most careful one."""
    d = _last(decisions, "action", ["reject", "unapprove", "approve", "retry"], at)
    j = staged.join(d, "id", "left").where("action is null or action <> 'reject'")
    approved = F.when(F.col("action") == "approve", 1).when(F.col("action") == "unapprove", 0).otherwise(F.col("approved"))
    return j.withColumn("approved", approved).withColumn("fail_count", F.when(F.col("action") == "retry", 0).otherwise(F.col("fail_count"))).drop("action")


def edit(staged: DataFrame, edits: DataFrame, at: str | None = None) -> DataFrame:
    """Edits (id, scrubbed_turns): the turns are replaced and approval is taken back; of several the last by ``at``."""
    order = F.struct(*([at] if at else []), "scrubbed_turns")
    e = edits.where("id is not null and scrubbed_turns is not null").groupBy("id").agg(F.max(order)["scrubbed_turns"].alias("_new"))
    j = staged.join(e, "id", "left")
    changed = F.col("_new").isNotNull()
    return j.withColumn("scrubbed_turns", F.coalesce("_new", "scrubbed_turns")).withColumn("approved", F.when(changed, 0).otherwise(F.col("approved"))).select(staged.columns)


def lease(staged: DataFrame, n: int) -> DataFrame:
    """The n oldest eligible rows are leased (uploaded -1)."""
    mine = oldest(eligible(staged), n).select("id").withColumn("_mine", F.lit(True))
    return staged.join(F.broadcast(mine), "id", "left").withColumn("uploaded", F.when(F.col("_mine"), -1).otherwise(F.col("uploaded"))).drop("_mine")


def settle(staged: DataFrame, outcomes: DataFrame, at: str | None = None) -> DataFrame:
    """Outcomes (id, outcome) of leased rows: ok uploads, rejected counts a failure and frees, anything else frees. A lease without outcome stays. Of several the last by ``at`` counts, else ok before rejected before others."""
    o = _last(outcomes, "outcome", ["ok", "rejected"], at)
    j = staged.join(o, "id", "left")
    leased = (F.col("uploaded") == -1) & F.col("outcome").isNotNull()
    up = F.when(leased & (F.col("outcome") == "ok"), 1).when(leased, 0).otherwise(F.col("uploaded"))
    fails = F.when(leased & (F.col("outcome") == "rejected"), F.col("fail_count") + 1).otherwise(F.col("fail_count"))
    return j.withColumn("fail_count", fails).withColumn("uploaded", up).drop("outcome")


def recover(staged: DataFrame) -> DataFrame:
    """Leases left over from a crash are freed."""
    return staged.withColumn("uploaded", F.when(F.col("uploaded") == -1, 0).otherwise(F.col("uploaded")))


def purgeable(exchanges: DataFrame, staged: DataFrame) -> DataFrame:
    """Processed exchanges whose record is uploaded."""
    return exchanges.where("status = 'processed'").join(staged.where("uploaded = 1").select(F.col("exchange_id").alias("id")).distinct(), "id", "left_semi")


def chunks(records: DataFrame, order: list[str], size: str, limit: int = P.CHUNK_BYTES) -> DataFrame:
    """(order, bytes, chunk): in order, over all rows, a new chunk starts when the next line would pass the limit; a line over the limit stands alone.

    ``order`` must tell rows apart, ``size`` is the bytes of a line. The fold is cut into blocks of the order, which are packed in parallel: how far a block's first chunk reaches depends
    on what the block before leaves open, so each block is packed for every place where its first cut can fall (these are the lines within one limit); then one pass over the blocks picks
    the places that follow from each other, a few rows a block, and the blocks are numbered.
    """
    spark = records.sparkSession
    parts = tasks(spark)
    narrow = records.select(*order, F.col(size).cast("long").alias("bytes")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = written(narrow.withColumn("_at", F.monotonically_increasing_id()), "lines").withColumn("_block", F.shiftright("_at", 33).cast("int"))

    def cuts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes before each line, and the line at which the chunk that starts at a line is over."""
        upto = np.cumsum(b)
        return upto - b, np.maximum(np.searchsorted(upto, upto - b + limit, "right"), np.arange(len(b)) + 1)

    def open_ends(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_at")
        b = p["bytes"].to_numpy()
        before, over = cuts(b)
        n, total = len(b), int(b.sum())
        carry, count = np.zeros(n, np.int64), np.ones(n, np.int64)
        for j in range(n - 1, -1, -1):
            if over[j] < n:
                carry[j], count[j] = carry[over[j]], 1 + count[over[j]]
            else:
                carry[j] = total - before[j]
        may = np.flatnonzero(before <= limit)
        return pd.DataFrame({"_block": int(p["_block"].iloc[0]), "upto": (before + b)[may], "carry": carry[may], "chunks": count[may], "total": total})

    ends = table.select("_block", "_at", "bytes").groupBy("_block").applyInPandas(open_ends, "_block int, upto long, carry long, chunks long, total long")
    starts: dict[int, tuple[int, int]] = {}
    carry, chunk = 0, 0
    block: int | None = None
    done = True
    for r in ends.orderBy("_block", "upto").toLocalIterator():
        if r["_block"] != block:
            if not done:
                carry += last
            block, done, last = r["_block"], False, r["total"]
            starts[block] = carry, chunk
        if not done and (not carry or carry + r["upto"] > limit):
            carry, chunk, done = r["carry"], chunk + r["chunks"], True

    def number(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_at").reset_index(drop=True)
        b = p["bytes"].to_numpy()
        before, over = cuts(b)
        open_, chunk = starts[int(p["_block"].iloc[0])]
        first = int(np.argmax(open_ + before + b > limit)) if open_ and (open_ + before + b > limit).any() else (len(b) if open_ else 0)
        new = np.zeros(len(b), np.int64)
        while first < len(b):
            new[first] = 1
            first = over[first]
        p["chunk"] = chunk + np.cumsum(new)
        return p.drop(columns=["_at", "_block"])

    kinds = dict(table.dtypes)
    return table.groupBy("_block").applyInPandas(number, ", ".join(f"`{c}` {kinds[c]}" for c in [*order, "bytes"]) + ", chunk long")


def published(staged: DataFrame) -> DataFrame:
    """Records as they are published: exactly six fields; the language unknown becomes null."""
    lang = F.when(~F.coalesce(F.col("language"), F.lit("unknown")).isin("unknown", ""), F.col("language"))
    return staged.select(F.col("id").alias("conversation_id"), F.col("scrubbed_turns").alias("turns"), "turn_count", lang.alias("language"), "quality_signals", (F.col("ner_scrubbed") == 1).alias("ner_scrubbed"))


def published_lines(staged: DataFrame) -> DataFrame:
    """staged with ``line``, the JSON line that is published, under an id of its own (made of the record's); rows whose turns or signals are no JSON are left out."""
    ok = F.try_parse_json("scrubbed_turns").isNotNull() & F.try_parse_json("quality_signals").isNotNull()
    lang = F.when(F.col("language").isNull() | (F.col("language") == "unknown"), F.lit("null")).otherwise(F.to_json(F.array("language")))
    lang = F.when(lang == "null", lang).otherwise(F.substr(lang, F.lit(2), F.length(lang) - 2))
    turns = F.to_json(F.from_json("scrubbed_turns", N.TURNS), {"ignoreNullFields": "false"})
    line = F.concat(
        F.lit('{"conversation_id":"'), N.as_uuid(F.md5(F.concat(F.lit("published|"), "id"))), F.lit('","turns":'), turns, F.lit(',"turn_count":'), F.coalesce(F.col("turn_count").cast("string"), F.lit("null")),
        F.lit(',"language":'), lang, F.lit(',"quality_signals":'), F.to_json(F.try_parse_json("quality_signals")), F.lit(',"ner_scrubbed":'), F.when(F.col("ner_scrubbed") != 0, "true").otherwise("false"), F.lit("}"),
    )
    return staged.where(ok).withColumn("line", line)


KEYS = ["conversation_id", "turns", "turn_count", "language", "quality_signals", "ner_scrubbed"]
WHOLE = ("BIGINT", "INT", "SMALLINT", "TINYINT")


def validate(lines: DataFrame, line: str = "line", rules: S.Blocklist | None = None) -> DataFrame:
    """``error`` of each line of a batch: the first check that fails, null if none.

    The record's fields come first, then the turns in order, each with its own checks: object, strings, role, fields, content filter (blocked:<category>) and
    personal data (pii:<type>). Types are those of the JSON, nothing is cast: a number is no text, and signals are numbers and booleans only.
    """
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    get = lambda k: F.variant_get("_v", f"$.{k}", "variant")
    text = lambda k: F.variant_get("_v", f"$.{k}", "string")
    turns = F.when(kind(get("turns")).startswith("ARRAY"), F.variant_get("_v", "$.turns", "array<variant>"))
    inner = lambda v, k: F.variant_get(v, f"$.{k}", "variant")
    is_text = lambda v, k: kind(inner(v, k)) == "STRING"
    number = lambda v: kind(v).isin(*WHOLE, "DOUBLE", "FLOAT", "BOOLEAN") | kind(v).startswith("DECIMAL")
    signals = F.when(kind(get("quality_signals")).startswith("OBJECT"), F.variant_get("_v", "$.quality_signals", "map<string,variant>"))

    def turn_error(t: Column) -> Column:
        return (
            F.when(~kind(t).startswith("OBJECT"), "turn")
            .when(~(is_text(t, "role") & is_text(t, "content")), "turn_text")
            .when(~F.variant_get(t, "$.role", "string").isin("user", "assistant"), "role")
            .when(F.size(F.array_except(F.map_keys(F.variant_get(t, "$", "map<string,variant>")), F.array(F.lit("role"), F.lit("content")))) > 0, "turn_field")
        )

    record = (
        F.when(F.col("_v").isNull() | ~kind(F.col("_v")).startswith("OBJECT"), F.when(F.col("_v").isNull(), "invalid_json").otherwise("turns"))
        .when(F.col("_turns").isNull(), "turns")
        .when((kind(get("conversation_id")) != "STRING") | ~F.coalesce(text("conversation_id").rlike("^[A-Za-z0-9_-]{1,128}$"), F.lit(False)), "conversation_id")
        .when(~kind(get("turn_count")).isin(*WHOLE), "turn_count")
        .when((kind(get("language")) != "VOID") & ((kind(get("language")) != "STRING") | ~F.coalesce(text("language").rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*$"), F.lit(False))), "language")
        .when(signals.isNull(), "quality_signals")
        .when(F.exists(F.map_values(signals), lambda v: ~number(v)), "signal_value")
        .when(kind(get("ner_scrubbed")) != "BOOLEAN", "ner_scrubbed")
        .when(F.size(F.array_except(F.json_object_keys(line), F.array(*map(F.lit, KEYS)))) > 0, "unknown_field")
    )
    d = lines.withColumn("_v", F.try_parse_json(F.col(line))).withColumn("_turns", turns).withColumn("_record", record)
    # contents are looked at only where the record is sound
    d = d.withColumn("_texts", F.when(F.col("_record").isNull(), F.transform("_turns", lambda t: F.when(is_text(t, "content"), F.variant_get(t, "$.content", "string")))))
    d = d.withColumn("_seen", S.gate_all_udf(rules or S.Blocklist.load())("_texts"))
    per_turn = F.zip_with(F.transform("_turns", turn_error), "_seen", lambda a, b: F.coalesce(a, b))
    return d.withColumn("error", F.coalesce("_record", F.get(F.filter(per_turn, lambda e: e.isNotNull()), F.lit(0)))).drop("_v", "_turns", "_record", "_texts", "_seen")


def batch_verdict(lines: DataFrame, batch: str, number: str) -> DataFrame:
    """A batch fails as a whole on its first bad line."""
    bad = F.col("error").isNotNull()
    return lines.groupBy(batch).agg(F.count("*").alias("lines"), F.min(F.when(bad, F.col(number))).alias("first_bad"), F.min(F.when(bad, F.struct(number, "error")))["error"].alias("error"))


def redact_by_hand(turns: Column, turn: Column, secret: Column) -> Column:
    """One turn with all occurrences of a text replaced by [REDACTED]; unchanged if the text is a placeholder or empty."""
    ok = (F.coalesce(secret, F.lit("")) != "") & ~secret.rlike(f"^{P.PLACEHOLDER}$")
    return F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), F.when(ok & (i == turn), F.replace(t["content"], secret, F.lit("[REDACTED]"))).otherwise(t["content"]).alias("content")))


def redacted(staged: DataFrame, redactions: DataFrame, rules: S.Blocklist | None = None) -> DataFrame:
    """staged with the texts of redactions (id, turn, secret; one an id) replaced, and ``blocked``: what the content filter says of the edited conversation."""
    r = redactions.where("id is not null").groupBy("id").agg(F.min(F.struct("turn", "secret")).alias("_r"))
    j = staged.join(r, "id", "left").withColumn("_t", F.from_json("scrubbed_turns", N.TURNS))
    j = j.withColumn("_t", F.when(F.col("_r").isNotNull(), redact_by_hand(F.col("_t"), F.col("_r.turn"), F.col("_r.secret"))).otherwise(F.col("_t")))
    texts = F.when(F.col("_r").isNotNull(), F.transform("_t", lambda x: x["content"]))
    j = j.withColumn("blocked", S.check_all_udf(rules or S.Blocklist.load())(texts)).withColumn("scrubbed_turns", F.when(F.col("_r").isNotNull(), F.to_json("_t")).otherwise(F.col("scrubbed_turns")))
    return j.select(*staged.columns, "blocked")


def next_step(stats: DataFrame) -> DataFrame:
    """What to do next, from the counts of pipeline_stats."""
    step = F.when(F.col("raw") > 0, "process").when(F.col("pending") > 0, "review").when(F.col("approved") > 0, "upload").when(F.col("dead_letters") > 0, "retry").otherwise("nothing")
    return stats.withColumn("next_step", step)


#: What an upload's status leads to: the chunk is done, its rows are sent one by one, or the run stops and the leases are freed.
ROUTES = {200: ("ok", "continue"), 409: ("ok", "continue"), 400: ("rejected", "isolate"), 413: ("rejected", "isolate"), 422: ("rejected", "isolate"), 401: ("auth", "stop"), 403: ("auth", "stop"), 503: ("ner_unavailable", "stop"), 429: ("rate_limited", "stop")}


def route(status: Column) -> Column:
    """(outcome, action) of a status; unknown ones are errors that stop the run."""
    pair = F.struct(F.lit("error").alias("outcome"), F.lit("stop").alias("action"))
    for code, (outcome, action) in ROUTES.items():
        pair = F.when(status == code, F.struct(F.lit(outcome).alias("outcome"), F.lit(action).alias("action"))).otherwise(pair)
    return pair


def backoff_seconds(attempt: Column, most: int = 300) -> Column:
    """Least wait before a retry; up to half a second of noise comes on top."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(most)))
