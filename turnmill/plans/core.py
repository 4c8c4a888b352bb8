"""Queries over the reference's operators, with SQL that DuckDB runs on the same tables. Each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnmill.functions import native as N
from turnmill.functions import patterns as P
from turnmill.functions import scrub as S
from turnmill.functions.lang import language
from turnmill.operators import audit as A
from turnmill.operators import lifecycle as L
from turnmill.operators import ner, process, rates, scoring
from turnmill.operators import turns as T
from turnmill.plans import corpus, planted
from turnmill.plans.registry import Registry
from turnmill.session import small

CORE = Registry()
add = CORE.add

# ---------------------------------------------------------------- SQL parts

TURNS_SQL = """'[{"role":"VARCHAR","content":"VARCHAR"}]'"""
STAGED = f"s AS (SELECT *, from_json(scrubbed_turns, {TURNS_SQL}) AS t FROM staged)"
SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
JOINED = "array_to_string(list_transform(t, lambda x: coalesce(x.content, '')), ' ')"
WORDS_SQL = f"list_filter(string_split_regex(lower({JOINED}), '{SPACE_SQL}'), lambda w: w <> '')"


def sql(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def language_sql(source: str) -> str:
    """(key, language) of source (key, text), by function words."""
    from turnmill.functions.lang import LEAST, WORDS

    words = f"list_filter(string_split_regex(lower(coalesce(text, '')), '{SPACE_SQL}'), lambda w: w <> '')"
    votes = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(sql(x) for x in v.split())}))) AS {k}_" for k, v in WORDS.items())
    best = "greatest(" + ", ".join(f"{k}_" for k in WORDS) + ")"
    pick = " ".join(f"WHEN {k}_ = best THEN '{k}'" for k in reversed(sorted(WORDS)))
    return f"lw AS (SELECT key, {words} AS w FROM ({source})), lv AS (SELECT key, {votes} FROM lw), lb AS (SELECT *, {best} AS best, {' + '.join(f'{k}_' for k in WORDS)} AS total FROM lv), lang AS (SELECT key, CASE WHEN best < {LEAST} * greatest(total, 1) THEN 'unknown' {pick} END AS language FROM lb)"


def turns(t, name="staged"):
    return t(name).withColumn("t", F.from_json("scrubbed_turns", N.TURNS))


# ---------------------------------------------------------------- extraction and usability

REQ = """'{"messages":[{"role":"VARCHAR","content":"VARCHAR"}],"prompt":"VARCHAR"}'"""
RES = """'{"choices":[{"message":{"content":"VARCHAR"}}],"message":{"content":"VARCHAR"},"response":"VARCHAR"}'"""


@add("extract_turns", f"""
WITH p AS (SELECT id, received_at, CASE WHEN json_valid(request_json) THEN from_json(request_json, {REQ}) END AS q, CASE WHEN json_valid(response_json) THEN from_json(response_json, {RES}) END AS r FROM exchanges),
a AS (SELECT id, received_at,
 CASE WHEN q.messages IS NOT NULL AND coalesce(r.choices[1].message.content, '') <> '' THEN list_append(q.messages, {{'role': 'assistant', 'content': r.choices[1].message.content}})
      WHEN q.messages IS NOT NULL AND coalesce(r.message.content, '') <> '' THEN list_append(q.messages, {{'role': 'assistant', 'content': r.message.content}})
      WHEN coalesce(q.prompt, '') <> '' AND coalesce(r.response, '') <> '' THEN [{{'role': 'user', 'content': q.prompt}}, {{'role': 'assistant', 'content': r.response}}] END AS t FROM p),
f AS (SELECT id, received_at, list_filter(t, lambda x: x.role IN ('user', 'assistant') AND coalesce(x.content, '') <> '') AS t FROM a WHERE t IS NOT NULL)
SELECT id, received_at, len(t) AS n_turns, list_sum(list_transform(t, lambda x: length(x.content))) AS chars, t[-1].role AS last_role, md5(array_to_string(list_transform(t, lambda x: x.content), ' ')) AS text_md5 FROM f""")  # fmt: skip
def extract_turns(t):
    e = T.extract_turns(t("exchanges"))
    return e.select("id", "received_at", F.size("turns").cast("long").alias("n_turns"), T.total_length(F.col("turns")).cast("long").alias("chars"), F.element_at("turns", -1)["role"].alias("last_role"), F.md5(T.joined(F.col("turns"))).alias("text_md5"))


USABLE = """k AS (SELECT line_no, list_filter(messages, lambda x: x.role IN ('user', 'assistant') AND coalesce(x.content, '') <> '') AS t FROM sample_messages),
c AS (SELECT line_no, CASE WHEN len(t) >= 2 AND t[-1].role <> 'assistant' THEN t[:-2] WHEN len(t) >= 2 THEN t END AS t FROM k),
u AS (SELECT line_no, t FROM c WHERE len(t) >= 2 AND t[-1].role = 'assistant')"""


@add("usable_samples", f"WITH {USABLE} SELECT line_no, len(t) - 1 AS request_turns, length(t[-1].content) AS response_chars FROM u")
def usable_samples(t):
    u = t("sample_messages").withColumn("x", T.to_exchange(F.col("messages"))).where("x is not null")
    return u.select("line_no", (F.size("x") - 1).cast("long").alias("request_turns"), F.length(F.element_at("x", -1)["content"]).cast("long").alias("response_chars"))


MIN_SQL = "k AS (SELECT line_no, list_filter(messages, lambda x: x.role IN ('user', 'assistant') AND coalesce(x.content, '') <> '') AS t FROM sample_messages), l AS (SELECT line_no, coalesce(list_sum(list_transform(t, lambda x: length(x.content))), 0)::BIGINT AS chars FROM k WHERE t IS NOT NULL)"


@add("min_length_gate", f"WITH {MIN_SQL} SELECT CASE WHEN chars < 50 THEN 'short' ELSE 'kept' END AS verdict, count(*) AS n, min(chars) AS least, max(chars) AS most FROM l GROUP BY 1")
def min_length_gate(t):
    chars = T.total_length(T.publishable(F.col("messages"))).cast("long")
    return t("sample_messages").where("messages is not null").select(chars.alias("chars")).groupBy(F.when(F.col("chars") < P.MIN_CHARS, "short").otherwise("kept").alias("verdict")).agg(F.count("*").alias("n"), F.min("chars").alias("least"), F.max("chars").alias("most"))


@add("unprocessed_scan", "SELECT id, created_at FROM exchanges WHERE status = 'raw' ORDER BY created_at, id, received_at LIMIT 100")
def unprocessed_scan(t):
    return t("exchanges").where("status = 'raw'").orderBy("created_at", "id", "received_at").limit(100).select("id", "created_at")


@add("dispositions", f"""
WITH p AS (SELECT json_valid(request_json) AS q, coalesce(json_valid(response_json), false) AS r, status FROM exchanges)
SELECT status, coalesce(q, false) AS request_ok, r AS response_ok, count(*) AS n FROM p GROUP BY ALL""")
def dispositions(t):
    ok = lambda c: F.try_parse_json(c).isNotNull()
    return t("exchanges").groupBy("status", ok("request_json").alias("request_ok"), ok("response_json").alias("response_ok")).agg(F.count("*").alias("n"))


#: A blocklist for the pipeline's query: the shipped one blocks nothing in these tables.
PIPELINE_RULES = S.Blocklist((("billing_topic", r"\binvoices?\b"),))


def _process_sql() -> str:
    turns = CORE.sql["extract_turns"].split("WITH p AS", 1)[1].rsplit("SELECT id, received_at", 1)[0]
    turns = turns.replace("FROM exchanges)", "FROM exchanges WHERE status = 'raw')", 1).replace("FROM a WHERE t IS NOT NULL)", "FROM a)")
    text = "array_to_string(list_transform(t, lambda x: x.content), ' ')"
    return f"""WITH p AS{turns},
n AS (SELECT row_number() OVER () AS key, id, received_at, t, {text} AS text, coalesce(list_sum(list_transform(t, lambda x: length(x.content))), 0) AS chars FROM f),
{language_sql('SELECT key, text FROM n')},
d AS (SELECT n.*, language, CASE WHEN t IS NULL THEN 'unparsed' WHEN chars < 50 THEN 'short' WHEN len(list_filter(t, lambda x: regexp_matches(x.content, '(?i)\\binvoices?\\b'))) > 0 THEN 'blocked:billing_topic' END AS reason FROM n JOIN lang USING (key))
SELECT id, received_at, CASE WHEN reason IS NULL THEN 'processed' ELSE 'skipped' END AS disposition, reason, CASE WHEN reason IS NULL THEN len(t) END AS turn_count, CASE WHEN reason IS NULL THEN language END AS language FROM d"""


@add("process_pipeline", _process_sql())
def process_pipeline(t):
    return process.process(t("exchanges"), PIPELINE_RULES).select("id", "received_at", "disposition", "reason", F.col("turn_count").cast("long").alias("turn_count"), "language")


@add("process_staged")
def process_staged(t):
    """What the pipeline stages; scrubbing has no SQL, tests compare with the plain functions."""
    return process.staged(process.process(t("exchanges"), PIPELINE_RULES)).drop("created_at")


@add("process_marked", f"WITH d AS ({_process_sql()}), m AS (SELECT id, min(disposition) AS new FROM d GROUP BY 1) SELECT CASE WHEN e.status = 'raw' THEN m.new ELSE e.status END AS status, count(*) AS n FROM exchanges e LEFT JOIN m USING (id) GROUP BY 1")
def process_marked(t):
    e = t("exchanges")
    return process.marked(e, process.process(e, PIPELINE_RULES)).groupBy("status").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- dedup

CANON = "to_json(list_transform(messages, lambda x: [coalesce(x.role, ''), coalesce(x.content, '')]))"


@add("conversation_hash_dedup", f"WITH h AS (SELECT line_no, file_name, sha256({CANON}) AS content_hash FROM sample_messages WHERE messages IS NOT NULL) SELECT content_hash, min(line_no) AS line_no, count(*) AS copies FROM h GROUP BY 1")
def conversation_hash_dedup(t):
    h = t("sample_messages").where("messages is not null").select("line_no", T.content_hash(F.col("messages")).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.min("line_no").alias("line_no"), F.count("*").alias("copies"))


@add("document_exact_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL GROUP BY text")
def document_exact_dedup(t):
    return t("documents").where("text is not null").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@add("redelivery_keep_first", "SELECT id, received_at, status FROM exchanges WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at NULLS FIRST, status) = 1")
def redelivery_keep_first(t):
    e = t("exchanges").where("id is not null")
    return e.groupBy("id").agg(F.min(F.struct("received_at", "status")).alias("m")).select("id", "m.received_at", "m.status")


@add("import_stats", f"""
WITH {USABLE}, h AS (SELECT s.file_name, s.line_no, s.messages IS NULL AS bad, u.line_no IS NOT NULL AS ok, sha256({CANON.replace('messages', 's.messages')}) AS hash FROM sample_messages s LEFT JOIN u USING (line_no)),
g AS (SELECT *, min(CASE WHEN ok THEN line_no END) OVER (PARTITION BY hash) AS first FROM h)
SELECT file_name, count(*) FILTER (ok AND line_no = first) AS imported, count(*) FILTER (NOT bad AND NOT ok) AS skipped_empty, count(*) FILTER (ok AND line_no <> first) AS skipped_duplicate, count(*) FILTER (bad) AS skipped_malformed FROM g GROUP BY 1""")  # fmt: skip
def import_stats(t):
    from turnmill.sources import importer

    c = t("sample_messages").select(F.lit("").alias("file"), F.col("line_no").alias("conv_no"), F.col("messages").alias("turns"), "file_name")
    return importer.statistics(importer.classified(c), "file_name")


# ---------------------------------------------------------------- quality

SIGNALS = f"""WITH {STAGED}, a AS (SELECT id, t, {JOINED} AS joined, {WORDS_SQL} AS w, list_filter(t, lambda x: x.role = 'assistant') AS ans FROM s)"""


@add("quality_signals", SIGNALS + r""" SELECT id, coalesce(round_even(list_sum(list_transform(ans, lambda x: length(x.content)))::DOUBLE / nullif(len(ans), 0), 0), 0)::BIGINT AS avg_response_len,
 regexp_matches(joined, '(?s)```.*?```') AS has_code, len(list_distinct(w)) AS distinct_words, len(w) AS words, coalesce(list_sum(list_transform(t, lambda x: length(x.content))), 0)::BIGINT AS total_length,
 len(list_filter(t, lambda x: x.role = 'user')) AS user_msg_count, len(ans) AS assistant_msg_count FROM a""")
def quality_signals(t):
    q = turns(t).select("id", T.signals(F.col("t")).alias("q")).select("id", "q.*")
    return q.select("id", "avg_response_len", "has_code", *(F.col(c).cast("long").alias(c) for c in ("distinct_words", "words", "total_length", "user_msg_count", "assistant_msg_count")))


@add("vocab_diversity", SIGNALS + " SELECT id, CASE WHEN len(w) = 0 THEN 0 ELSE round(len(list_distinct(w))::DOUBLE / len(w), 3) END AS vocab_diversity FROM a")
def vocab_diversity(t):
    q = turns(t).select("id", T.signals(F.col("t")).alias("q"))
    return q.select("id", F.when(F.col("q.words") == 0, 0.0).otherwise(F.round(F.col("q.distinct_words") / F.col("q.words"), 3)).alias("vocab_diversity"))


# ---------------------------------------------------------------- languages, counts, lists


@add("lang_counts", "SELECT language, count(*) AS n FROM staged WHERE uploaded = 0 GROUP BY 1 ORDER BY n DESC, language")
def lang_counts(t):
    return t("staged").where("uploaded = 0").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


@add("non_english_warning", "SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'unknown') GROUP BY 1")
def non_english_warning(t):
    return t("documents").where(~F.col("lang").isin("en", "unknown")).groupBy("lang").agg(F.count("*").alias("n"))


@add("language_of_documents", f"WITH {language_sql('SELECT doc_id AS key, text FROM documents')} SELECT key AS doc_id, language FROM lang")
def language_of_documents(t):
    return t("documents").select("doc_id", language(F.col("text")).alias("language"))


@add("pipeline_stats", """
SELECT (SELECT count(*) FILTER (status = 'raw') FROM exchanges) AS raw, (SELECT count(*) FILTER (status = 'processed') FROM exchanges) AS processed, (SELECT count(*) FILTER (status = 'skipped') FROM exchanges) AS skipped,
 count(*) FILTER (approved = 0 AND uploaded = 0) AS pending, count(*) FILTER (approved = 1 AND uploaded = 0) AS approved, count(*) FILTER (uploaded = 1) AS uploaded, count(*) FILTER (uploaded = 0 AND fail_count >= 3) AS dead_letters FROM staged""")
def pipeline_stats(t):
    n = lambda c: F.count_if(F.expr(c))
    e = t("exchanges").agg(*(n(f"status = '{x}'").alias(x) for x in ("raw", "processed", "skipped")))
    s = t("staged").agg(n("approved = 0 and uploaded = 0").alias("pending"), n("approved = 1 and uploaded = 0").alias("approved"), n("uploaded = 1").alias("uploaded"), n("uploaded = 0 and fail_count >= 3").alias("dead_letters"))
    return e.crossJoin(s)  # one row each


@add("next_step", "WITH p AS (" + CORE.sql["pipeline_stats"] + ") SELECT CASE WHEN raw > 0 THEN 'process' WHEN pending > 0 THEN 'review' WHEN approved > 0 THEN 'upload' WHEN dead_letters > 0 THEN 'retry' ELSE 'nothing' END AS next_step FROM p")
def next_step(t):
    return L.next_step(pipeline_stats.__wrapped__(t)).select("next_step")


@add("pending_review", "SELECT id, created_at FROM staged WHERE approved = 0 AND uploaded = 0 ORDER BY created_at, id LIMIT 50")
def pending_review(t):
    return L.oldest(L.pending(t("staged")), 50).select("id", "created_at")


@add("upload_eligible", "SELECT id, created_at FROM staged WHERE approved = 1 AND uploaded = 0 AND fail_count < 3 ORDER BY created_at, id LIMIT 100")
def upload_eligible(t):
    return L.oldest(L.eligible(t("staged")), 100).select("id", "created_at")


@add("dead_letters", "SELECT id, created_at, fail_count FROM staged WHERE fail_count >= 3 AND uploaded = 0 ORDER BY created_at, id LIMIT 50")
def dead_letters(t):
    return L.oldest(L.dead(t("staged")), 50).select("id", "created_at", "fail_count")


@add("audit_scope", "SELECT id FROM staged WHERE uploaded = 0 OR (uploaded = 1 AND NOT EXISTS (SELECT 1 FROM staged WHERE uploaded = 0))")
def audit_scope(t):
    return L.audit_scope(t("staged")).select("id")


# ---------------------------------------------------------------- joins and sets


@add("purge_candidates", "SELECT DISTINCT e.id FROM exchanges e JOIN staged s ON s.exchange_id = e.id WHERE s.uploaded = 1 AND e.status = 'processed'")
def purge_candidates(t):
    return L.purgeable(t("exchanges"), t("staged")).select("id").distinct()


@add("retained_after_purge", "SELECT status, count(*) AS n FROM exchanges e WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.exchange_id = e.id AND s.uploaded = 1 AND e.status = 'processed') GROUP BY 1")
def retained_after_purge(t):
    e = t("exchanges")
    gone = L.purgeable(e, t("staged")).select("id").distinct()
    return e.where("status <> 'processed' or status is null").unionByName(e.where("status = 'processed'").join(gone, "id", "left_anti")).groupBy("status").agg(F.count("*").alias("n"))


@add("leases_unsettled", "SELECT id FROM staged WHERE uploaded = -1 EXCEPT SELECT id FROM staged WHERE fail_count > 0")
def leases_unsettled(t):
    s = t("staged")
    return s.where("uploaded = -1").select("id").exceptAll(s.where("uploaded = -1 and fail_count > 0").select("id"))


@add("staged_sources", "WITH e AS (SELECT id, max(session_id) AS session_id FROM exchanges GROUP BY 1) SELECT source, count(*) AS n, sum(turn_count) AS turns FROM staged s LEFT JOIN e ON e.id = s.exchange_id LEFT JOIN sessions x ON x.session_id = e.session_id GROUP BY 1")
def staged_sources(t):
    e = t("exchanges").where("id is not null").groupBy(F.col("id").alias("exchange_id")).agg(F.max("session_id").alias("session_id"))
    return t("staged").join(e, "exchange_id", "left").join(t("sessions"), "session_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.sum("turn_count").alias("turns"))


# ---------------------------------------------------------------- detectors

DOCS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {planted.values()}) v(doc_id, text))"
DOC_MATCH = "SELECT doc_id, len(regexp_extract_all(text, {p})) AS n, md5(array_to_string(regexp_extract_all(text, {p}), '|')) AS found FROM " + DOCS.replace("{", "{{").replace("}", "}}") + " WHERE regexp_matches(text, {p})"
TURN_ROWS = f"WITH {STAGED}, r AS (SELECT id, unnest(t) AS x FROM s), c AS (SELECT id, x.content AS text FROM r UNION ALL SELECT 'planted' || doc_id, text FROM (VALUES {planted.values()}) v(doc_id, text))"


def documents(t):
    """The documents and the planted texts."""
    d = t("documents").select("doc_id", "text")
    return d.unionByName(planted.frame(d.sparkSession))


def turn_texts(t):
    """(id, text) of all turns and the planted texts."""
    c = turns(t).select("id", F.explode("t").alias("x")).select("id", F.col("x.content").alias("text"))
    return c.unionByName(planted.frame(c.sparkSession).select(F.concat(F.lit("planted"), "doc_id").alias("id"), "text"))


def found_in_documents(t, pattern):
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return documents(t).select("doc_id", hits.alias("h")).where(F.size("h") > 0).select("doc_id", F.size("h").cast("long").alias("n"), F.md5(F.array_join("h", "|")).alias("found"))


def found_in_turns(t, patterns, flags=""):
    """Records with matches, and how many."""
    c = turn_texts(t)
    n = sum((F.size(F.regexp_extract_all("text", F.lit(flags + p), F.lit(0))) for p in patterns), F.lit(0))
    return c.groupBy("id").agg(F.sum(n).alias("n")).where("n > 0")


def turns_sql(patterns):
    n = " + ".join(f"len(regexp_extract_all(text, {sql(p)}))" for p in patterns)
    return f"{TURN_ROWS} SELECT id, sum({n})::BIGINT AS n FROM c GROUP BY id HAVING sum({n}) > 0"


def _detectors() -> None:
    """One query a detector; look-arounds have no SQL and are tested against brute force."""
    for name, p, ok in (("email", P.EMAIL, True), ("phone_nanp", P.PHONE, True), ("phone_intl", P.PHONE_INTL, True), ("state_zip", P.STATE_ZIP, True), ("street_address", P.ADDRESS, True), ("keyed_secret", P.KEYED, True)):
        add(f"detect_{name}", DOC_MATCH.format(p=sql(p)) if ok else None)(lambda t, p=p: found_in_documents(t, p))
        add(f"detect_{name}_turns", turns_sql([p]) if ok else None)(lambda t, p=p: found_in_turns(t, [p]))
    add("detect_vendor_secret_turns", turns_sql(P.VENDOR))(lambda t: found_in_turns(t, P.VENDOR))
    add("detect_block_secret_turns", turns_sql(P.BLOCK))(lambda t: found_in_turns(t, P.BLOCK))
    add("detect_home_path_turns", turns_sql(P.PATHS))(lambda t: found_in_turns(t, P.PATHS))
    for name, p in (("ipv4", P.IPV4), ("ipv6", P.IPV6), ("base64", P.BASE64), ("dotted_token", P.DOTTED)):
        add(f"detect_{name}_turns")(lambda t, p=p: found_in_turns(t, [p]))


_detectors()

SSN_WIDE = r"\b\d{3}-\d{2}-\d{4}\b"


@add("detect_ssn_turns", f"""{TURN_ROWS}, m AS (SELECT id, unnest(regexp_extract_all(text, {sql(SSN_WIDE)})) AS m FROM c)
SELECT id, count(*) AS n FROM m WHERE m[1:3] <> '000' AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:11] <> '0000' GROUP BY id""")
def detect_ssn_turns(t):
    return found_in_turns(t, [P.SSN])


@add("detect_credit_card_luhn", f"""
WITH m AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, {sql(P.CARD)})), '[ -]', '', 'g') AS d FROM {DOCS}),
l AS (SELECT doc_id, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[length(d) - i + 1]::INT WHEN d[length(d) - i + 1]::INT > 4 THEN 2 * d[length(d) - i + 1]::INT - 9 ELSE 2 * d[length(d) - i + 1]::INT END)) AS s FROM m)
SELECT doc_id, count(*) FILTER (s % 10 = 0) AS valid, count(*) FILTER (s % 10 <> 0) AS invalid FROM l GROUP BY 1""")
def detect_credit_card_luhn(t):
    m = documents(t).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(P.CARD), F.lit(0))).alias("m"))
    ok = F.call_function("luhn_check", F.regexp_replace("m", "[ -]", ""))
    return m.groupBy("doc_id").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@add("entropy_of_tokens", f"""{TURN_ROWS}, m AS (SELECT DISTINCT unnest(regexp_extract_all(text, {sql(P.GENERIC)})) AS token FROM c),
k AS (SELECT token, unnest(string_split(token, '')) AS ch FROM m), f AS (SELECT token, ch, count(*)::DOUBLE AS n FROM k GROUP BY ALL)
SELECT token, round(-sum(n / length(token) * log2(n / length(token))), 6) + 0.0 AS bits FROM f GROUP BY token""")
def entropy_of_tokens(t):
    c = turn_texts(t).select(F.explode(F.regexp_extract_all("text", F.lit(P.GENERIC), F.lit(0))).alias("token")).distinct()
    return c.select("token", F.round(N.entropy(F.col("token")), 6).alias("bits"))


@add("redact_simple", f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, {sql(P.EMAIL)}, '[EMAIL]', 'g'), {sql(P.PHONE)}, '[PHONE]', 'g'), {sql(P.STATE_ZIP)}, '[LOCATION]', 'g')) AS text_md5 FROM {DOCS}")
def redact_simple(t):
    r = F.col("text")
    for p, tag in ((P.EMAIL, "[EMAIL]"), (P.PHONE, "[PHONE]"), (P.STATE_ZIP, "[LOCATION]")):
        r = F.regexp_replace(r, p, tag)
    return documents(t).select("doc_id", F.md5(r).alias("text_md5"))


@add("redact_cards")
def redact_cards(t):
    return documents(t).select("doc_id", F.md5(N.redact_cards(F.col("text"))).alias("text_md5"))


@add("url_reduce", rf"""
WITH u AS (SELECT doc_id, text, regexp_extract_all(text, {sql(P.URL)}) AS m, string_split_regex(text, {sql(P.URL)}) AS gaps FROM {DOCS}),
h AS (SELECT doc_id, gaps, list_transform(m, lambda x: lower(regexp_extract(x, {sql(P.URL)}, 1))) AS hosts FROM u WHERE len(m) > 0),
r AS (SELECT doc_id, gaps, list_transform(hosts, lambda x: '[URL:' || CASE WHEN contains(x, '.') AND string_split(x, '.')[-1] IN ({', '.join(map(sql, P.SPAM_TLDS))}) THEN 'suspicious' ELSE x END || ']') AS new FROM h)
SELECT doc_id, array_to_string(list_transform(gaps, lambda g, i: g || coalesce(new[i], '')), '') AS reduced FROM r""")
def url_reduce(t):
    return documents(t).where(F.col("text").rlike(P.URL)).select("doc_id", N.reduce_urls(F.col("text")).alias("reduced"))


# ---------------------------------------------------------------- scrub, gate, content


@add("scrub_documents")
def scrub_documents(t):
    return documents(t).select("doc_id", S.scrub_udf("text").alias("text"))


@add("scrub_turns")
def scrub_turns(t):
    texts = S.scrub_all_udf(F.transform("t", lambda x: x["content"]))
    x = turns(t).select("id", "t", texts.alias("c"))
    return x.select("id", F.zip_with("t", "c", lambda a, c: F.struct(a["role"].alias("role"), c.alias("content"))).alias("turns"))


@add("gate_check_pii")
def gate_check_pii(t):
    return documents(t).select("doc_id", S.check_pii_udf("text").alias("kind")).where("kind is not null")


@add("round_trip_law")
def round_trip_law(t):
    """What the gate still sees after scrubbing."""
    return documents(t).select("doc_id", S.check_pii_udf(S.scrub_udf("text")).alias("kind")).where("kind is not null")


@add("content_filter_flags")
def content_filter_flags(t):
    check = S.check_all_udf(S.Blocklist.load())
    return turns(t).select("id", check(F.transform("t", lambda x: x["content"])).alias("category")).where("category is not null")


_KIND = "coalesce(json_type(line, '$.{k}'), '')"
_GOOD = "CASE WHEN json_valid(line) THEN line END"
VALIDATE_SQL = f"""
WITH l AS (SELECT line_no, line AS raw, CASE WHEN json_valid(line) THEN line END AS line FROM (VALUES {planted.line_values()}) v(line_no, line)),
e AS (SELECT line_no, line, CASE WHEN line IS NULL THEN 'invalid_json' WHEN {_KIND.format(k='turns')} <> 'ARRAY' THEN 'turns'
 WHEN {_KIND.format(k='conversation_id')} <> 'VARCHAR' OR NOT regexp_full_match(json_extract_string(line, '$.conversation_id'), '[A-Za-z0-9_-]{{1,128}}') THEN 'conversation_id'
 WHEN {_KIND.format(k='turn_count')} NOT IN ('BIGINT', 'UBIGINT') THEN 'turn_count'
 WHEN {_KIND.format(k='language')} <> 'NULL' AND ({_KIND.format(k='language')} <> 'VARCHAR' OR NOT regexp_full_match(json_extract_string(line, '$.language'), '[A-Za-z]{{2,3}}(-[A-Za-z0-9]{{1,8}})*')) THEN 'language'
 WHEN {_KIND.format(k='quality_signals')} <> 'OBJECT' THEN 'quality_signals'
 WHEN len(list_filter(json_keys(line, '$.quality_signals'), lambda k: json_type(line, '$.quality_signals.' || k) NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN'))) > 0 THEN 'signal_value'
 WHEN {_KIND.format(k='ner_scrubbed')} <> 'BOOLEAN' THEN 'ner_scrubbed'
 WHEN len(list_filter(json_keys(line), lambda k: k NOT IN ({', '.join(map(sql, L.KEYS))}))) > 0 THEN 'unknown_field' END AS error FROM l),
t AS (SELECT line_no, unnest(range(json_array_length(line, '$.turns')::BIGINT)) AS i, line FROM e WHERE error IS NULL),
j AS (SELECT line_no, i, json_extract(line, '$.turns[' || i || ']') AS turn FROM t),
k AS (SELECT line_no, i, json_extract_string(turn, '$.content') AS text, CASE WHEN json_type(turn) <> 'OBJECT' THEN 'turn'
 WHEN coalesce(json_type(turn, '$.role'), '') <> 'VARCHAR' OR coalesce(json_type(turn, '$.content'), '') <> 'VARCHAR' THEN 'turn_text'
 WHEN json_extract_string(turn, '$.role') NOT IN ('user', 'assistant') THEN 'role'
 WHEN len(list_filter(json_keys(turn), lambda x: x NOT IN ('role', 'content'))) > 0 THEN 'turn_field' END AS error FROM j),
m AS (SELECT line_no, i, coalesce(error, CASE WHEN regexp_matches(text, {sql(P.EMAIL)}) THEN 'pii:email' WHEN regexp_matches(text, {sql(SSN_WIDE)}) THEN 'pii:ssn' WHEN regexp_matches(text, {sql(P.PHONE)}) THEN 'pii:phone' END) AS error FROM k),
f AS (SELECT line_no, arg_min(error, i) AS error FROM m WHERE error IS NOT NULL GROUP BY 1),
v AS (SELECT e.line_no, coalesce(e.error, f.error) AS error FROM e LEFT JOIN f USING (line_no))"""


@add("gate_validate_records", VALIDATE_SQL + " SELECT line_no, error FROM v")
def gate_validate_records(t):
    return L.validate(planted.line_frame(t("region").sparkSession)).select("line_no", "error")


@add("gate_batch_verdict", VALIDATE_SQL + " SELECT line_no % 7 AS batch, count(*) AS lines, min(line_no) FILTER (error IS NOT NULL) AS first_bad, arg_min(error, line_no) FILTER (error IS NOT NULL) AS error FROM v GROUP BY 1")
def gate_batch_verdict(t):
    v = L.validate(planted.line_frame(t("region").sparkSession)).withColumn("batch", F.col("line_no") % 7)
    return L.batch_verdict(v, "batch", "line_no")


@add("gate_published_records")
def gate_published_records(t):
    """What the gate says of all records as they would be published."""
    return L.validate(L.published_lines(t("staged"))).groupBy("error").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- audit

IP_OK = r"list_filter(regexp_extract_all(joined, '\b(?:\d{1,3}\.){3}\d{1,3}\b'), lambda m: len(list_filter(string_split(m, '.'), lambda o: o::INT > 255)) = 0 AND NOT regexp_matches(m, '^(?:0|1\.0|2\.0|127)\.'))"


def _leak_counts() -> str:
    parts = []
    for k, p in P.AUDIT.items():
        if k == "ip_address":
            x = IP_OK
        elif k == "ssn":
            x = f"list_filter(regexp_extract_all(joined, {sql(SSN_WIDE)}), lambda m: m[1:3] <> '000' AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:11] <> '0000')"
        else:
            x = f"regexp_extract_all(joined, {sql(p)})"
        parts.append(f"least(len({x}), 3) AS {k}")
    return ", ".join(parts)


AUDIT_SQL = f"WITH {STAGED}, a AS (SELECT id, {JOINED} AS joined, {WORDS_SQL} AS w FROM s)"


@add("audit_leaks", f"{AUDIT_SQL}, l AS (SELECT id, {_leak_counts()} FROM a) SELECT * FROM l WHERE {' + '.join(P.AUDIT)} > 0")
def audit_leaks(t):
    a = A.audit(turns(t).select("id", T.joined(F.col("t")).alias("joined")), "id", "joined").where(F.size("leaks") > 0)
    return a.select("id", *(F.coalesce(F.size(F.col("leaks")[k]), F.lit(0)).cast("long").alias(k) for k in P.AUDIT)).select("id", *(F.greatest(F.col(k), F.lit(0)).cast("long").alias(k) for k in P.AUDIT))


DENSITY_SQL = f"{AUDIT_SQL}, d AS (SELECT id, len(w) AS word_count, len(regexp_extract_all(joined, {sql(P.PLACEHOLDER)})) AS placeholder_count FROM a)"


@add("audit_density", f"{DENSITY_SQL} SELECT id, word_count, placeholder_count, placeholder_count::DOUBLE / greatest(word_count, 1) AS density FROM d")
def audit_density(t):
    a = A.audit(turns(t).select("id", T.joined(F.col("t")).alias("joined")), "id", "joined")
    return a.select("id", F.col("word_count").cast("long"), F.col("placeholder_count").cast("long"), "density")


@add("audit_rollup", f"{DENSITY_SQL}, l AS (SELECT id, {_leak_counts()} FROM a) SELECT count(*) AS total, count(*) FILTER ({' + '.join(P.AUDIT)} > 0) AS leak_count, count(*) FILTER (placeholder_count::DOUBLE / greatest(word_count, 1) > 0.25) AS high_density FROM d JOIN l USING (id)")
def audit_rollup(t):
    return A.rollup(A.audit(turns(t).select("id", T.joined(F.col("t")).alias("joined")), "id", "joined"))


def _report_sql() -> str:
    parts = []
    for k, p in P.AUDIT.items():
        x = IP_OK if k == "ip_address" else f"list_filter(regexp_extract_all(joined, {sql(SSN_WIDE)}), lambda m: m[1:3] <> '000' AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:11] <> '0000')" if k == "ssn" else f"regexp_extract_all(joined, {sql(p)})"
        parts.append(f"SELECT id, '{k}' AS kind, array_to_string({x}[1:3], ', ') AS examples, joined[1:40] AS preview FROM a WHERE len({x}) > 0")
    return " UNION ALL ".join(parts)


@add("audit_leak_report", f"{AUDIT_SQL} {_report_sql()}")
def audit_leak_report(t):
    return A.leak_report(A.audit(turns(t).select("id", T.joined(F.col("t")).alias("joined")), "id", "joined"), "id")


@add("audit_density_report", f"{DENSITY_SQL} SELECT id, floor(100.0 * placeholder_count / greatest(word_count, 1))::BIGINT AS density_pct FROM d WHERE placeholder_count::DOUBLE / greatest(word_count, 1) > 0.02 ORDER BY placeholder_count::DOUBLE / greatest(word_count, 1) DESC, id")
def audit_density_report(t):
    # records over 2 %, as few of these tables are over the report's 25 %
    a = A.audit(turns(t).select("id", T.joined(F.col("t")).alias("joined")), "id", "joined")
    return A.density_report(a, "id", 0.02).select("id", F.floor(100 * F.col("placeholder_count") / F.greatest("word_count", F.lit(1))).alias("density_pct"))


# ---------------------------------------------------------------- toxicity ladder, names


LADDER_TERMS = ("abuse", "hate", "sexual")


@add("toxicity_ladder", f"""WITH {STAGED}, j AS (SELECT id, lower({JOINED}) AS joined FROM s), f AS (SELECT lower(term) AS term, category, weight FROM flag_terms WHERE term IS NOT NULL),
x AS (SELECT id, max(CASE WHEN category = 'abuse' THEN weight END) AS a, max(CASE WHEN category = 'hate' THEN weight END) AS h, max(CASE WHEN category = 'sexual' THEN weight END) AS s FROM j JOIN f ON contains(joined, term) GROUP BY id),
r AS (SELECT id, CASE WHEN a > 0.6 THEN 'ml_insult' WHEN h > 0.6 THEN 'ml_identity_attack' WHEN s > 0.6 THEN 'ml_sexual_explicit' END AS category FROM x) SELECT id, category FROM r WHERE category IS NOT NULL""")
def toxicity_ladder(t):
    """The ladder on scores of a term provider: the heaviest flag term of each category (terms are few, their number is checked)."""
    rows = t("flag_terms").where("term is not null").limit(10_001).collect()  # one more than may be
    if len(rows) > 10_000:
        raise ValueError("more flag terms than an expression may hold")
    terms = [(r["term"].lower(), r["category"], r["weight"]) for r in rows]
    low = F.lower(T.joined(F.col("t")))

    def heaviest(kind):
        ws = [F.when(F.contains(F.col("low"), F.lit(x)), F.lit(float(w))) for x, c, w in terms if c == kind]
        return F.greatest(*ws, F.lit(None).cast("double")) if ws else F.lit(None).cast("double")

    s = turns(t).select("id", low.alias("low")).select("id", *(heaviest(c).alias(c) for c in LADDER_TERMS))
    out = F.coalesce(F.when(F.col("abuse") > 0.6, "ml_insult"), F.when(F.col("hate") > 0.6, "ml_identity_attack"), F.when(F.col("sexual") > 0.6, "ml_sexual_explicit"))
    return s.select("id", out.alias("category")).where("category is not null")


def _seven_sql() -> str:
    score = lambda i: f"(('0x' || substr(md5(id), {2 * i + 1}, 2))::INT / 255.0)"
    return "SELECT id, CASE " + " ".join(f"WHEN {score(i)} > {t} THEN 'ml_{c}'" for i, (c, t) in enumerate(P.TOXICITY)) + " END AS category FROM staged"


@add("toxicity_ladder_scores", _seven_sql())
def toxicity_ladder_scores(t):
    """The ladder's seven thresholds in order, on scores made of the id's hash: no model is installed."""
    score = lambda i: F.conv(F.substring(F.md5("id"), 2 * i + 1, 2), 16, 10).cast("int") / 255.0
    return t("staged").select("id", N.ladder({c: score(i) for i, (c, _) in enumerate(P.TOXICITY)}).alias("category"))


@add("name_numbering", r"""
WITH m AS (SELECT line_no, i AS turn, messages[i + 1].content AS text FROM sample_messages, range(0, 100) r(i) WHERE i < len(messages)),
w AS (SELECT line_no, turn, string_split_regex(text, '[^\p{L}\p{M}\p{Nd}_-]+') AS ws FROM m WHERE text IS NOT NULL),
p AS (SELECT line_no, turn, ws, generate_subscripts(ws, 1) AS pos FROM w), k AS (SELECT line_no, turn, lower(ws[pos]) AS name, pos FROM p),
f AS (SELECT line_no, turn, k.name, min(pos) AS first_pos FROM k JOIN (SELECT DISTINCT lower(name) AS name FROM known_names) n ON n.name = k.name GROUP BY ALL)
SELECT line_no, turn, name, row_number() OVER (PARTITION BY line_no, turn ORDER BY first_pos, name) AS number FROM f""")
def name_numbering(t):
    m = t("sample_messages").select("line_no", F.posexplode("messages").alias("turn", "m")).select("line_no", "turn", F.posexplode(F.split("m.content", r"[^\p{L}\p{M}\p{Nd}_-]+")).alias("pos", "w"))
    n = t("known_names").select(F.lower("name").alias("name")).distinct()
    k = m.select("line_no", "turn", F.lower("w").alias("name"), "pos").join(n, "name").withColumn("text_id", F.struct("line_no", "turn"))
    return T.first_appearance(k, "text_id", "name", "pos").select("text_id.line_no", F.col("text_id.turn").cast("long").alias("turn"), "name", F.col("number").cast("long").alias("number"))


@add("ner_scrub_documents")
def ner_scrub_documents(t):
    names = tuple(sorted(r["name"] for r in t("known_names").where("name is not null").select("name").distinct().limit(200_001).collect()))
    if len(names) > 200_000:
        raise ValueError("more known names than may be sent to every worker")
    return ner.scrub_names(t("documents").select("doc_id", "text"), "text", ner.Gazetteer(names)).select("doc_id", "scrubbed", "entities")


# ---------------------------------------------------------------- rates on events


@add("rate_limit_hourly", """WITH c AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY ALL),
l AS (SELECT *, CASE user_id % 4 WHEN 1 THEN 10 WHEN 2 THEN 25 WHEN 3 THEN 50 ELSE 10 END AS lim FROM c) SELECT user_id, window_start, n, least(n, lim) AS allowed, greatest(n - lim, 0) AS rejected FROM l""")
def rate_limit_hourly(t):
    # the tier of a user is made of the id
    return rates.over_limit(rates.windowed(t("events"), "ts", "hour", "user_id"), rates.tier_limit((F.col("user_id") % 4).cast("int")).cast("long"))


@add("rate_limit_minute", "WITH c AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY 1) SELECT window_start, n, least(n, 100) AS allowed, greatest(n - 100, 0) AS rejected FROM c")
def rate_limit_minute(t):
    return rates.over_limit(rates.windowed(t("events"), "ts", "minute"), F.lit(P.MINUTE_LIMIT).cast("long"))


@add("daily_cap", "WITH c AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, window_start, n, least(n, 3) AS allowed, greatest(n - 3, 0) AS rejected FROM c")
def daily_cap(t):
    return rates.over_limit(rates.windowed(t("events"), "ts", "day", "user_id"), F.lit(P.REGISTER_DAY).cast("long"))


@add("cooldown_flags", "SELECT event_id, ts < min(ts) OVER (PARTITION BY user_id) + INTERVAL 1 HOUR AS cooling FROM events")
def cooldown_flags(t):
    return rates.cooldown(t("events"), "user_id", "ts").select("event_id", "cooling")


@add("ttl_dedup_30d", "WITH p AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events) SELECT event_id FROM p WHERE prev IS NULL OR ts > prev + INTERVAL 30 DAY")
def ttl_dedup_30d(t):
    return rates.ttl_first(t("events"), ["user_id", "event_type"], "ts", "event_id").select("event_id")


@add("tier_decay", "SELECT user_id, CASE WHEN max((event_type = 'error')::INT) = 1 THEN 1 ELSE 3 END AS tier, sum((event_type = 'error')::INT)::BIGINT AS violations FROM events GROUP BY 1")
def tier_decay(t):
    return rates.decay(t("events"), "user_id", F.col("event_type") == "error")


OUTCOME = """WITH m AS (SELECT *, count(*) OVER (PARTITION BY date_trunc('minute', ts)) AS mn, count(*) OVER (PARTITION BY user_id, date_trunc('hour', ts)) AS hn, min(ts) OVER (PARTITION BY user_id) AS first, row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT event_id, user_id, CASE WHEN value * 100000 > 2097152 THEN 'too_large' WHEN user_id % 10 = 0 THEN 'auth' WHEN epoch(ts) - epoch(first) < 3600 THEN 'cooldown' WHEN mn > 100 THEN 'minute' WHEN hn > 10 THEN 'hour' WHEN rn > 1 THEN 'duplicate' WHEN event_type = 'error' THEN 'invalid' WHEN event_id % 50 = 0 THEN 'ner' ELSE 'ok' END AS gate FROM m),
o AS (SELECT *, CASE gate WHEN 'too_large' THEN 413 WHEN 'auth' THEN 401 WHEN 'cooldown' THEN 429 WHEN 'minute' THEN 429 WHEN 'hour' THEN 429 WHEN 'duplicate' THEN 409 WHEN 'invalid' THEN 422 WHEN 'ner' THEN 503 ELSE 200 END AS status FROM g)"""


def _with_aggregate(e, agg, keys):
    """agg joined back to the rows by keys, nulls equal to each other; broadcast if it is small, so that no hot key is shuffled."""
    a = small(agg.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in agg.columns if c not in keys)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return e.join(a, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def outcomes(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    # counts and firsts are aggregates joined back: they are partial before the shuffle, a window would sort hot keys whole
    e = e.withColumn("minute", F.date_trunc("minute", "ts")).withColumn("hour", F.date_trunc("hour", "ts"))
    base = e
    e = _with_aggregate(e, base.groupBy("minute").agg(F.count("*").alias("mn")), ["minute"])
    e = _with_aggregate(e, base.groupBy("user_id", "hour").agg(F.count("*").alias("hn")), ["user_id", "hour"])
    e = _with_aggregate(e, base.groupBy("user_id").agg(F.min("ts").alias("first")), ["user_id"])
    e = _with_aggregate(e, base.groupBy("user_id", "event_type", "value").agg(F.min(F.struct("ts", "event_id")).alias("one")), ["user_id", "event_type", "value"])
    age = F.unix_micros("ts") / 1e6 - F.unix_micros("first") / 1e6
    gate = rates.upload_gate(F.col("value") * 100000, F.col("user_id") % 10 != 0, age, F.col("mn"), F.col("hn"), F.lit(10), F.struct("ts", "event_id") != F.col("one"), F.col("event_type") != "error", F.col("event_id") % 50 != 0)
    return e.select("event_id", "user_id", gate.alias("gate")).withColumn("status", rates.status_of(F.col("gate")))


@add("metric_counters", OUTCOME + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER (gate = '{g}') AS value FROM o" for m, g in rates.COUNTERS.items()) + " UNION ALL SELECT 'uploads_failed', count(*) FILTER (gate <> 'ok') FROM o)")
def metric_counters(t):
    return rates.counters(outcomes(t))


REGISTER = """WITH m AS (SELECT *, row_number() OVER (PARTITION BY user_id % 5, date_trunc('minute', ts) ORDER BY ts, event_id) AS n FROM events),
d AS (SELECT *, count(*) FILTER (n <= 10) OVER (PARTITION BY user_id % 5, date_trunc('day', ts) ORDER BY ts, event_id) AS day_n FROM m)"""


@add("registration_limits", REGISTER + " SELECT event_id, CASE WHEN n > 10 THEN 'flood' WHEN day_n > 3 THEN 'limited' ELSE 'ok' END AS outcome FROM d")
def registration_limits(t):
    # the address of an attempt is made of the user
    return rates.registrations(t("events").withColumn("address", F.col("user_id") % 5), "address", "ts", "event_id").select("event_id", "outcome")


@add("ttl_contributions_90d", "WITH p AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) SELECT event_id FROM p WHERE prev IS NULL OR ts > prev + INTERVAL 90 DAY")
def ttl_contributions_90d(t):
    return rates.ttl_first(t("events"), ["user_id"], "ts", "event_id", rates.CONTRIBUTION_TTL).select("event_id")


@add("ttl_device_codes", "WITH p AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id) AS prev FROM events) SELECT event_id FROM p WHERE prev IS NULL OR ts > prev + INTERVAL 600 SECOND")
def ttl_device_codes(t):
    return rates.ttl_first(t("events").withColumn("device", F.col("user_id") % 5), ["device", "event_type"], "ts", "event_id", rates.DEVICE_TTL).select("event_id")


@add("purge_totals", "SELECT (SELECT count(*) FROM exchanges) AS exchanges, (SELECT count(*) FROM staged) AS staged, (SELECT count(DISTINCT e.id) FROM exchanges e JOIN staged s ON s.exchange_id = e.id WHERE s.uploaded = 1 AND e.status = 'processed') AS purgeable")
def purge_totals(t):
    e, s = t("exchanges"), t("staged")
    return e.agg(F.count("*").alias("exchanges")).crossJoin(s.agg(F.count("*").alias("staged"))).crossJoin(L.purgeable(e, s).agg(F.count_distinct("id").alias("purgeable")))  # one row each


@add("upload_outcome_ladder", OUTCOME + " SELECT event_id, status FROM o")
def upload_outcome_ladder(t):
    return outcomes(t).select("event_id", "status")


@add("metrics_rollup", OUTCOME + " SELECT status, count(*) AS n, count(DISTINCT user_id) AS keys FROM o GROUP BY 1")
def metrics_rollup(t):
    return outcomes(t).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("keys"))


@add("contributions_per_key", "SELECT contributor, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(added_at) AS first_at, max(added_at) AS last_at FROM documents GROUP BY 1")
def contributions_per_key(t):
    return t("documents").groupBy("contributor").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("added_at").alias("first_at"), F.max("added_at").alias("last_at"))


@add("contributor_files", "WITH r AS (SELECT contributor, doc_id, row_number() OVER (PARTITION BY contributor ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY contributor) AS files FROM documents) SELECT contributor, files, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS first_files FROM r WHERE n <= 20 GROUP BY ALL")
def contributor_files(t):
    """Files of each contributor: how many, and a page of the first 20. The page is a limit within groups, which is taken before the shuffle."""
    d = t("documents").select("contributor", "doc_id")
    first = d.withColumn("n", F.row_number().over(Window.partitionBy("contributor").orderBy("doc_id"))).where("n <= 20")
    page = first.groupBy("contributor").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("first_files"))
    return d.groupBy(F.col("contributor").alias("c")).agg(F.count("*").alias("files")).join(page, F.col("c").eqNullSafe(F.col("contributor"))).select("contributor", "files", "first_files")


# ---------------------------------------------------------------- lifecycle, publishing


@add("decisions_applied", "SELECT id, CASE WHEN fail_count = 1 THEN 1 WHEN fail_count = 2 THEN 0 ELSE approved END AS approved, uploaded, CASE WHEN fail_count >= 3 AND ner_scrubbed = 1 THEN 0 ELSE fail_count END AS fail_count FROM staged WHERE NOT (fail_count = 0 AND turn_count > 6)")
def decisions_applied(t):
    s = t("staged")
    action = F.when(F.col("fail_count") == 1, "approve").when(F.col("fail_count") == 2, "unapprove").when((F.col("fail_count") >= 3) & (F.col("ner_scrubbed") == 1), "retry").when((F.col("fail_count") == 0) & (F.col("turn_count") > 6), "reject")
    return L.decide(s, s.select("id", action.alias("action")).where("action is not null")).select("id", "approved", "uploaded", "fail_count")


@add("leases_settled", "SELECT id, CASE WHEN uploaded = -1 AND turn_count % 3 = 0 THEN 1 WHEN uploaded = -1 THEN 0 ELSE uploaded END AS uploaded, CASE WHEN uploaded = -1 AND turn_count % 3 = 1 THEN fail_count + 1 ELSE fail_count END AS fail_count FROM staged")
def leases_settled(t):
    s = t("staged")
    o = s.select("id", F.when(F.col("turn_count") % 3 == 0, "ok").when(F.col("turn_count") % 3 == 1, "rejected").otherwise("error").alias("outcome"))
    return L.settle(s, o).select("id", "uploaded", "fail_count")


@add("leases_recovered", "SELECT CASE WHEN uploaded = -1 THEN 0 ELSE uploaded END AS uploaded, count(*) AS n FROM staged GROUP BY 1")
def leases_recovered(t):
    return L.recover(t("staged")).groupBy("uploaded").agg(F.count("*").alias("n"))


@add("auto_approve", "SELECT count(*) AS n FROM (SELECT id FROM staged WHERE approved = 0 AND uploaded = 0 ORDER BY created_at, id LIMIT 50)")
def auto_approve(t):
    s = t("staged")
    d = L.oldest(L.pending(s), 50).select("id", F.lit("approve").alias("action"))
    return L.decide(s, d).where("approved = 1").join(L.pending(s).select("id"), "id", "left_semi").agg(F.count("*").alias("n"))


@add("published_records", "SELECT id AS conversation_id, turn_count, CASE WHEN language NOT IN ('unknown', '') THEN language END AS language, ner_scrubbed = 1 AS ner_scrubbed FROM staged WHERE uploaded = 1")
def published_records(t):
    return L.published(t("staged").where("uploaded = 1")).select("conversation_id", "turn_count", "language", "ner_scrubbed")


@add("manual_redaction", f"WITH {STAGED} SELECT id, md5(array_to_string(list_transform(t, lambda x, i: CASE WHEN i = 1 THEN replace(x.content, 'the', '[REDACTED]') ELSE x.content END), ' ')) AS text_md5 FROM s")
def manual_redaction(t):
    r = L.redact_by_hand(F.col("t"), F.lit(0), F.lit("the"))
    return turns(t).select("id", F.md5(T.joined(r)).alias("text_md5"))


LINE_BYTES = f"""strlen(to_json(t)) + strlen(json(quality_signals)) + length(coalesce(turn_count::VARCHAR, 'null')) + CASE WHEN language IS NULL OR language = 'unknown' THEN 4 ELSE strlen(language) + 2 END + CASE WHEN ner_scrubbed <> 0 THEN 4 ELSE 5 END + {len('{"conversation_id":"","turns":,"turn_count":,"language":,"quality_signals":,"ner_scrubbed":}') + 36 + 1}"""


@add("chunk_packing", f"""
WITH RECURSIVE {STAGED}, d AS (SELECT created_at, id, {LINE_BYTES} AS bytes, row_number() OVER (ORDER BY created_at, id) AS rn FROM s WHERE json_valid(scrubbed_turns) AND json_valid(quality_signals)),
f AS (SELECT id, rn, bytes, bytes AS size, 1 AS chunk FROM d WHERE rn = 1 UNION ALL
 SELECT d.id, d.rn, d.bytes, CASE WHEN f.size + d.bytes > 262144 THEN d.bytes ELSE f.size + d.bytes END, CASE WHEN f.size + d.bytes > 262144 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN d ON d.rn = f.rn + 1)
SELECT id, chunk::BIGINT AS chunk, bytes::BIGINT AS bytes FROM f""")
def chunk_packing(t):
    lines = L.published_lines(t("staged")).select("created_at", "id", (F.octet_length("line") + 1).alias("size"))
    return L.chunks(lines, ["created_at", "id"], "size").select("id", "chunk", "bytes")


@add("leases_taken", "WITH m AS (SELECT id FROM staged WHERE approved = 1 AND uploaded = 0 AND fail_count < 3 ORDER BY created_at, id LIMIT 100) SELECT id FROM m")
def leases_taken(t):
    s = t("staged")
    return L.lease(s, 100).where("uploaded = -1").join(L.eligible(s).select("id"), "id", "left_semi").select("id")


# ---------------------------------------------------------------- sources' scalar parts


@add("capture_path_filter", """
WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/v1/chat/completions/' WHEN 1 THEN '/x/api/chat?a=1' WHEN 2 THEN '/api/generate' WHEN 3 THEN '/v1/models' ELSE '/api/chats' END AS path FROM documents)
SELECT path, count(*) AS n FROM p WHERE regexp_matches(rtrim(split_part(path, '?', 1), '/'), '(/v1/chat/completions|/api/chat|/api/generate)$') GROUP BY 1""")
def capture_path_filter(t):
    k = F.col("doc_id") % 5
    path = F.when(k == 0, "/v1/chat/completions/").when(k == 1, "/x/api/chat?a=1").when(k == 2, "/api/generate").when(k == 3, "/v1/models").otherwise("/api/chats")
    return t("documents").select(path.alias("path")).where(N.captured_path(F.col("path"))).groupBy("path").agg(F.count("*").alias("n"))


@add("role_map_sharegpt", "WITH m AS (SELECT unnest(messages) AS m FROM sample_messages), r AS (SELECT CASE m.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE m.role END AS f FROM m) SELECT f AS said_by, CASE f WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'system' THEN 'system' END AS role, count(*) AS n FROM r GROUP BY ALL")
def role_map_sharegpt(t):
    m = t("sample_messages").select(F.explode("messages").alias("m"))
    f = F.when(F.col("m.role") == "user", "human").when(F.col("m.role") == "assistant", "gpt").otherwise(F.col("m.role"))
    return m.select(f.alias("said_by")).select("said_by", N.share_role(F.col("said_by")).alias("role")).groupBy("said_by", "role").agg(F.count("*").alias("n"))


@add("content_block_flatten", "SELECT line_no, md5(array_to_string(list_filter(list_transform(messages, lambda x: trim(coalesce(x.content, ''), ' ')), lambda x: x <> ''), chr(10))) AS text_md5 FROM sample_messages WHERE messages IS NOT NULL")
def content_block_flatten(t):
    blocks = F.to_json(F.transform("messages", lambda m: F.struct(F.lit("text").alias("type"), F.struct(F.coalesce(m["content"], F.lit("")).alias("value")).alias("text"))))
    return t("sample_messages").where("messages is not null").select("line_no", F.md5(N.content_blocks(blocks)).alias("text_md5"))


EDGES = "e AS (SELECT line_no, i AS node, CASE WHEN i = 0 THEN NULL WHEN i % 3 = 0 THEN i - 2 ELSE i - 1 END AS parent, messages[i + 1] AS m FROM sample_messages, range(0, 1000) r(i) WHERE i < len(messages))"
STRIPPED = f"regexp_replace(regexp_replace(m.content, '^{SPACE_SQL}', ''), '{SPACE_SQL}$', '')"
WALKED = f"SELECT line_no, count(*) AS turns, md5(string_agg({STRIPPED}, '|' ORDER BY depth)) AS text_md5 FROM w WHERE m.role IN ('user', 'assistant') AND coalesce({STRIPPED}, '') <> '' GROUP BY 1"


def _walked(t, path_of):
    """Turns on a path through each line's messages, linked as in EDGES, by one of the two walks."""

    def run(parts):
        for p in parts:
            out = [path_of([None if m is None else (m["role"], m["content"]) for m in ms], [None if i == 0 else i - 2 if i % 3 == 0 else i - 1 for i in range(len(ms))]) for ms in p["messages"]]
            p["turns"], p["text"] = [len(x) for x in out], ["|".join(c for _, c in x) for x in out]
            yield p[["line_no", "turns", "text"]]

    d = t("sample_messages").where(F.size("messages") > 0).select("line_no", "messages").mapInPandas(run, "line_no long, turns long, text string")
    return d.where("turns > 0").select("line_no", "turns", F.md5("text").alias("text_md5"))


def _mapping_path(messages, parents):
    from turnmill.sources.trees import first_child_path

    return first_child_path({str(i): {"parent": None if p is None else str(p), "message": {"author": {"role": m and m[0]}, "content": {"parts": [m and m[1]]}}} for i, (m, p) in enumerate(zip(messages, parents, strict=True))})


def _branch_path(messages, parents):
    from turnmill.sources.trees import active_branch

    listed = [{"id": str(i), "parentId": None if p is None else str(p), "role": m and m[0], "content": m and m[1]} for i, (m, p) in enumerate(zip(messages, parents, strict=True))]
    return active_branch({"messages": listed, "history": {"currentId": str(len(messages) - 1)}})


@add("tree_first_child", f"""WITH RECURSIVE {EDGES}, c AS (SELECT line_no, parent, min(node) AS node FROM e WHERE parent IS NOT NULL GROUP BY ALL),
w AS (SELECT line_no, node, m, 1 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT w.line_no, c.node, e.m, w.depth + 1 FROM w JOIN c ON c.line_no = w.line_no AND c.parent = w.node JOIN e ON e.line_no = c.line_no AND e.node = c.node) {WALKED}""")
def tree_first_child(t):
    return _walked(t, _mapping_path)


@add("tree_active_branch", f"""WITH RECURSIVE {EDGES}, b AS (SELECT line_no, node, parent, m, 1 AS back FROM e WHERE (line_no, node) IN (SELECT (line_no, max(node)) FROM e GROUP BY line_no)
UNION ALL SELECT e.line_no, e.node, e.parent, e.m, b.back + 1 FROM b JOIN e ON e.line_no = b.line_no AND e.node = b.parent), w AS (SELECT line_no, m, -back AS depth FROM b) {WALKED}""")
def tree_active_branch(t):
    return _walked(t, _branch_path)


# ---------------------------------------------------------------- scores, streams


def _score_sql(scope: str) -> str:
    """Score of the plain scanner on the corpus."""
    out = "input"
    for p in scoring.PLAIN:
        out = f"regexp_replace({out}, {sql(p)}, '[REDACTED]', 'g')"
    return f"""WITH c AS (SELECT *, {out} AS out FROM (VALUES {corpus.values()}) v(id, input, kind, value, guard, sensitive)),
h AS (SELECT count(*) FILTER (NOT contains(out, value)) AS hits, count(*) AS total FROM c WHERE value IS NOT NULL AND {scope}),
g AS (SELECT id, bool_or((NOT sensitive AND out <> input) OR NOT contains(out, guard)) AS bad FROM c WHERE guard IS NOT NULL GROUP BY 1), k AS (SELECT count(*) FILTER (bad) AS false_positives, count(*) AS guards FROM g)
SELECT hits, total, CASE WHEN total > 0 THEN floor(100 * hits / total)::BIGINT END AS recall_pct, false_positives, guards, CASE WHEN guards > 0 THEN floor(100 * false_positives / guards)::BIGINT END AS over_redaction_pct FROM h, k"""


def _scored(s):
    return s.select(*(F.col(c).cast("long").alias(c) for c in ("hits", "total", "recall_pct", "false_positives", "guards", "over_redaction_pct")))


@add("scanner_score")
def scanner_score(t):
    """Of the scrub chain, which has no SQL; tests hold it against a loop."""
    return _scored(scoring.score(corpus.frame(t("region").sparkSession), S.scrub_udf("input")))


for _scope, _where in {"all": "true", "secret": "kind LIKE 'secret/%'", "pii": "kind NOT LIKE 'secret/%'"}.items():
    add(f"plain_scanner_score_{_scope}", _score_sql(_where))(lambda t, scope=_scope: _scored(scoring.score(corpus.frame(t("region").sparkSession), scoring.plain_scrub(F.col("input")), scope)))


@add("corpus_problems", f"""WITH c AS (SELECT DISTINCT id, input, value, guard FROM (VALUES {corpus.values()}) v(id, input, kind, value, guard, sensitive))
SELECT count(*) FILTER (value IS NOT NULL AND NOT contains(input, value)) + count(*) FILTER (guard IS NOT NULL AND NOT contains(input, guard)) AS problems, count(DISTINCT id) AS cases FROM c""")
def corpus_problems(t):
    c = corpus.frame(t("region").sparkSession)
    return scoring.problems(c).agg(F.count("*").alias("problems")).crossJoin(c.agg(F.count_distinct("id").alias("cases")))  # one row each


@add("upload_routes", OUTCOME + " SELECT CASE WHEN status IN (200, 409) THEN 'ok' WHEN status IN (400, 413, 422) THEN 'rejected' WHEN status IN (401, 403) THEN 'auth' WHEN status = 503 THEN 'ner_unavailable' WHEN status = 429 THEN 'rate_limited' ELSE 'error' END AS outcome, count(*) AS n FROM o GROUP BY 1")
def upload_routes(t):
    return outcomes(t).groupBy(L.route(F.col("status"))["outcome"].alias("outcome")).agg(F.count("*").alias("n"))


@add("burst_limit", "WITH c AS (SELECT user_id, date_trunc('minute', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, window_start, n, least(n, 60) AS allowed, greatest(n - 60, 0) AS rejected FROM c")
def burst_limit(t):
    return rates.over_limit(rates.windowed(t("events"), "ts", "minute", "user_id"), F.lit(60).cast("long"))


@add("flag_rate")
def flag_rate(t):
    return scoring.flag_rate(t("documents"), "source", "text", S.scrub_udf("text"))


def _stream(t, table):
    """The table's files as a stream."""
    df = t(table)
    folder, name = df.inputFiles()[0].rsplit("/", 1)
    reader = df.sparkSession.readStream.schema(df.schema)
    return reader.parquet(folder) if name.startswith("part-") else reader.option("pathGlobFilter", name).parquet(folder)


def _ran(stream, latest=None):
    """The stream's result over what is there now, through the shared folder; ``latest``: of rows with the same of these columns the last."""
    from turnmill.session import folder_of
    from turnmill.streaming import windows

    base = folder_of(stream.sparkSession)
    return windows.run_updates(stream, f"{base}/out", f"{base}/check", latest) if latest else windows.run(stream, f"{base}/out", f"{base}/check")


@add("stream_rate_window", "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, user_id % 5 AS address, count(*) AS n, least(count(*), 10) AS allowed FROM events GROUP BY ALL")
def stream_rate_window(t):
    from turnmill.streaming import windows

    s = _stream(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("address"))
    n = _ran(windows.counts(s, "ts", "1 hour", "2 hours", "address"), ["address", "window_start"])
    return n.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "address", "n", F.least("n", F.lit(10).cast("long")).alias("allowed"))


@add("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t):
    from turnmill.streaming import windows

    s = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _ran(windows.first_within(s, ["user_id", "event_type"], "ts")).select("user_id", "event_type")
