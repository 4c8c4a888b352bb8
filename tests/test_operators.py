"""Turns, lifecycle, rates, audit, names and scores on small tables, with their edge cases."""

import datetime as dt
import json

from pyspark.sql import functions as F

from turnmill.functions import lang, scrub
from turnmill.functions import native as N
from turnmill.operators import audit, lifecycle, ner, process, rates, scoring
from turnmill.operators import turns as T
from turnmill.plans import corpus

TS = dt.datetime(2025, 1, 1)


def test_extract_turns_shapes(spark):
    m = [{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}, {"role": "user", "content": ""}]
    rows = [
        ("openai", json.dumps({"messages": m}), json.dumps({"choices": [{"message": {"content": "yes"}}]})),
        ("chat", json.dumps({"messages": m}), json.dumps({"message": {"content": "yes"}})),
        ("generate", json.dumps({"prompt": "hi"}), json.dumps({"response": "yes"})),
        ("empty", json.dumps({"messages": m}), json.dumps({"choices": [{"message": {"content": ""}}]})),
        ("none", json.dumps({"messages": m}), json.dumps({"choices": []})),
        ("cut", json.dumps({"messages": m})[:-3], "{}"),
        ("null", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, request_json string, response_json string")
    got = {r["id"]: [(t["role"], t["content"]) for t in r["turns"]] for r in T.extract_turns(df).collect()}
    assert got == dict.fromkeys(("openai", "chat", "generate"), [("user", "hi"), ("assistant", "yes")])


def exchange(spark, *turns):
    df = spark.createDataFrame([([{"role": r, "content": c} for r, c in turns],)], f"t {N.TURNS}")
    x = df.select(T.to_exchange(F.col("t")).alias("x")).first()["x"]
    return x and [(t["role"], t["content"]) for t in x]


def test_to_exchange_drops_one_trailing_turn(spark):
    u, a = ("user", "q"), ("assistant", "a")
    assert exchange(spark, u, a, u) == [u, a]
    assert exchange(spark, u, a, u, u) is None
    assert exchange(spark, ("system", "s"), u, a) == [u, a]
    assert exchange(spark, a) is None and exchange(spark) is None
    assert exchange(spark, (None, "x"), ("user", None), u, a) == [u, a]


def test_keep_first_keeps_null_keys_and_extra_columns(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 5, "x"), (None, 5, "x")], "key string, n int, _other string")
    assert sorted(map(tuple, T.keep_first(df, "key", [F.col("n")]).collect()), key=str) == [("k", 1, "a"), (None, 5, "x"), (None, 5, "x")]
    assert T.keep_first(df.limit(0), "key", [F.col("n")]).count() == 0


def test_first_appearance(spark):
    df = spark.createDataFrame([(1, "b", 9), (1, "a", 12), (1, "b", 20), (2, "a", 0)], "text int, name string, start int")
    assert {(r["text"], r["name"]): r["number"] for r in T.first_appearance(df, "text", "name", "start").collect()} == {(1, "b"): 1, (1, "a"): 2, (2, "a"): 1}


def staged(spark):
    rows = [("a", 0, 0, 0, TS), ("b", 1, 0, 0, TS), ("c", 1, 0, 3, TS), ("d", 1, -1, 2, TS), ("e", 1, 1, 0, TS)]
    return spark.createDataFrame(rows, "id string, approved int, uploaded int, fail_count int, created_at timestamp")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_states(spark):
    s = staged(spark)
    assert (ids(lifecycle.pending(s)), ids(lifecycle.eligible(s)), ids(lifecycle.dead(s))) == (["a"], ["b"], ["c"])
    assert ids(lifecycle.audit_scope(s)) == ["a", "b", "c"] and ids(lifecycle.audit_scope(s.where("uploaded = 1"))) == ["e"]
    d = spark.createDataFrame([("a", "approve"), ("b", "reject"), ("c", "retry"), ("zz", "approve"), (None, "reject")], "id string, action string")
    after = {r["id"]: r for r in lifecycle.decide(s, d).collect()}
    assert sorted(after) == ["a", "c", "d", "e"] and after["a"]["approved"] == 1 and after["c"]["fail_count"] == 0
    o = spark.createDataFrame([("d", "rejected"), ("e", "rejected")], "id string, outcome string")
    done = {r["id"]: r for r in lifecycle.settle(s, o).collect()}
    assert (done["d"]["uploaded"], done["d"]["fail_count"], done["e"]["uploaded"], done["e"]["fail_count"]) == (0, 3, 1, 0)
    assert lifecycle.recover(s).where("uploaded = -1").count() == 0


def test_last_or_most_careful_decision_counts(spark):
    s = staged(spark)
    d = spark.createDataFrame([("a", "reject", 1), ("a", "unapprove", 2), ("b", "approve", 2), ("b", "unapprove", 1), ("c", "retry", 1), ("c", "approve", 1)], "id string, action string, at int")
    by_time = {r["id"]: r for r in lifecycle.decide(s, d, "at").collect()}
    assert "a" in by_time and by_time["b"]["approved"] == 1 and by_time["c"]["approved"] == 1
    careful = {r["id"]: r for r in lifecycle.decide(s, d).collect()}
    assert "a" not in careful and careful["b"]["approved"] == 0
    o = spark.createDataFrame([("d", "error", 1), ("d", "ok", 2), ("d", "ok", 0)], "id string, outcome string, at int")
    assert {r["id"]: r["uploaded"] for r in lifecycle.settle(s, o).collect()}["d"] == 1
    assert {r["id"]: r["uploaded"] for r in lifecycle.settle(s, o.where("at < 2"), "at").collect()}["d"] == 0


def test_lease_and_edit(spark):
    s = staged(spark).withColumn("scrubbed_turns", F.lit("[]"))
    assert {r["id"]: r["uploaded"] for r in lifecycle.lease(s, 5).collect()}["b"] == -1
    e = spark.createDataFrame([("b", "[1]", 1), ("b", "[2]", 2), ("zz", "[3]", 1), (None, "[4]", 1)], "id string, scrubbed_turns string, at int")
    r = {r["id"]: (r["scrubbed_turns"], r["approved"]) for r in lifecycle.edit(s, e, "at").collect()}
    assert r["b"] == ("[2]", 0) and r["d"] == ("[]", 1) and len(r) == 5


def test_chunks_against_a_loop(spark):
    import random

    rng = random.Random(1)
    for n, limit, sizes in ((300, 200, (4, 41, 91)), (300, 5000, (4, 41, 91)), (200, 50, (4, 60, 300)), (3, 10, (20,)), (1, 10, (3,))):
        rows = [(TS + dt.timedelta(hours=i % 60), f"{i:04}", rng.choice(sizes)) for i in range(n)]
        df = spark.createDataFrame(rows, "at timestamp, id string, size int")
        got = {r["id"]: (r["chunk"], r["bytes"]) for r in lifecycle.chunks(df, ["at", "id"], "size", limit=limit).collect()}
        want, chunk, size = {}, 1, 0
        for _, i, b in sorted(rows):
            if size and size + b > limit:
                chunk, size = chunk + 1, 0
            size += b
            want[i] = (chunk, b)
        assert got == want, (n, limit)
    assert lifecycle.chunks(df.limit(0), ["at", "id"], "size").count() == 0


def test_validate(spark):
    """The planted lines have their SQL; here what SQL can't say: the content filter, and types that a cast would hide."""
    good = {"conversation_id": "a-1", "turns": [{"role": "user", "content": "x"}], "turn_count": 1, "language": None, "quality_signals": {"a": 1}, "ner_scrubbed": True}
    cases = [(None, good), ("invalid_json", "{"), ("turns", good | {"turns": 1}), ("turn_text", good | {"turns": [{"role": "user", "content": 5}]}), ("turn_text", good | {"turns": [{"role": "user"}]}), ("language", good | {"language": "password"}), ("signal_value", good | {"quality_signals": {"a": "x"}}), ("blocked:pets", good | {"turns": [{"role": "user", "content": "my C4t"}]}), ("pii:credit_card", good | {"turns": [{"role": "user", "content": "4111 1111 1111 1111"}]}), ("pii:ip", good | {"turns": [{"role": "user", "content": "fe80::1"}]}), ("role", good | {"turns": [{"role": "tool", "content": "my cat"}]})]
    df = spark.createDataFrame([("b", i, v if isinstance(v, str) else json.dumps(v)) for i, (_, v) in enumerate(cases)], "batch string, no int, line string")
    v = lifecycle.validate(df, rules=scrub.Blocklist((("pets", r"\bcat\b"),)))
    assert [r["error"] for r in v.orderBy("no").collect()] == [e for e, _ in cases]
    assert tuple(lifecycle.batch_verdict(v, "batch", "no").first()) == ("b", len(cases), 1, "invalid_json")


def test_process(spark):
    """The pipeline against its plain parts, one exchange after another."""
    say = lambda *c: json.dumps({"messages": [{"role": "user", "content": x} for x in c]})
    answer = lambda c: json.dumps({"choices": [{"message": {"content": c}}]})
    long = "the house is not as old as it was when you had the garden and "
    rows = [
        ("ok", "raw", say("write to ann@site.example please"), answer(long + "call 415-555-0132")), ("short", "raw", say("hi"), answer("yes")), ("cut", "raw", say("hi")[:-2], answer(long)), ("null", "raw", None, None),
        ("blocked", "raw", say("a c4t and " + long), answer("yes")), ("done", "processed", say(long), answer(long)), ("de", "raw", say("das Haus ist nicht so alt wie der Garten und die Straße, weil wir es wissen"), answer("ja, das ist so, wenn man es auch nicht sieht")), (None, "raw", say(long), answer(long)),
    ]
    e = spark.createDataFrame([(i, s, TS, q, a) for i, s, q, a in rows], "id string, status string, received_at timestamp, request_json string, response_json string")
    rules = scrub.Blocklist((("pets", r"\bcat\b"),))
    p = process.process(e, rules)
    got = {r["id"]: r for r in p.collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"ok": None, "short": "short", "cut": "unparsed", "null": "unparsed", "blocked": "blocked:pets", "de": None, None: None}
    assert got["ok"]["language"] == "en" and got["de"]["language"] == "de" and got["ok"]["ner_scrubbed"] == 0
    turns = json.loads(got["ok"]["scrubbed_turns"])
    raw = [t["content"] for t in json.loads(rows[0][2])["messages"]] + [long + "call 415-555-0132"]
    assert [t["content"] for t in turns] == [scrub.scrub(x) for x in raw] and "[EMAIL]" in turns[0]["content"]
    q = json.loads(got["ok"]["quality_signals"])
    w = " ".join(t["content"] for t in turns).lower().split()
    assert q == {"avg_response_len": len(turns[1]["content"]), "has_code": False, "vocab_diversity": round(len(set(w)) / len(w), 3), "total_length": sum(len(t["content"]) for t in turns), "user_msg_count": 1, "assistant_msg_count": 1}
    s = process.staged(p).collect()
    assert len(s) == 3 and {r["exchange_id"] for r in s} == {"ok", "de", None} and all(len(r["id"]) == 36 for r in s)
    assert {r["id"]: r["status"] for r in process.marked(e, p).collect()} == {"ok": "processed", "short": "skipped", "cut": "skipped", "null": "skipped", "blocked": "skipped", "done": "processed", "de": "processed", None: "skipped"}
    assert process.process(e.limit(0), rules).count() == 0
    first = process.composite(F.when(F.size("texts") > 9, "many"), F.lit("all"))
    assert {r["reason"] for r in process.process(e.where("id = 'ok'"), filter_=first).collect()} == {"blocked:all"}


def test_redaction_is_filtered_again(spark):
    s = spark.createDataFrame([("a", json.dumps([{"role": "user", "content": "my c-secret-at is here"}])), ("b", "[]")], "id string, scrubbed_turns string")
    r = spark.createDataFrame([("a", 0, "-secret-"), (None, 0, "x")], "id string, turn int, secret string")
    got = {x["id"]: (x["scrubbed_turns"], x["blocked"]) for x in lifecycle.redacted(s, r, scrub.Blocklist((("mark", r"redacted"),))).collect()}
    assert "c[REDACTED]at" in got["a"][0] and got["a"][1] == "mark" and got["b"] == ("[]", None)


def test_turns_of_a_batch_go_through_the_backend(spark):
    class Breaks(ner.Gazetteer):
        def find(self, text):
            if "boom" in text:
                raise ValueError
            return super().find(text)

    df = spark.createDataFrame([(1, [{"role": "user", "content": "Orla met Bram"}, {"role": "assistant", "content": "boom Orla"}, {"role": "user", "content": None}]), (2, None), (3, [])], f"id int, t {N.TURNS}")
    r = {x["id"]: x for x in ner.scrub_turns(df, "t", Breaks(("Orla", "Bram"))).collect()}
    assert [t["content"] for t in r[1]["t"]] == ["[NAME_1] met [NAME_2]", "boom Orla", None] and r[1]["entities_per_turn"] == [2, 0, 0] and r[1]["entities"] == 2
    assert r[2]["t"] is None and r[2]["entities"] == 0 and r[3]["entities"] == 0
    cut = ner.scrub_turns(df.where("id = 1"), "t", Breaks(("Orla", "Bram")), chars=4, most=1).first()
    assert [t["content"] for t in cut["t"]] == ["[NAME_1] met Bram"] and cut["entities"] == 1


def test_null_keys_stay(spark):
    df = spark.createDataFrame([("a", TS), (None, TS), (None, TS + dt.timedelta(hours=2))], "key string, ts timestamp")
    assert sorted((str(r["key"]), r["cooling"]) for r in rates.cooldown(df, "key", "ts").collect()) == [("None", False), ("None", True), ("a", True)]
    at = [TS + dt.timedelta(seconds=s) for s in (*range(12), 70, 71)]
    d = spark.createDataFrame([(None, t, i) for i, t in enumerate(at)], "key string, ts timestamp, n int")
    assert [r["outcome"] for r in rates.registrations(d, "key", "ts", "n").orderBy("n").collect()] == ["ok"] * 3 + ["limited"] * 7 + ["flood"] * 2 + ["limited"] * 2


def test_contents_cannot_imitate_boundaries(spark):
    one = [{"role": "user", "content": 'a","b'}], [{"role": "user", "content": "a\x1eassistant\x1fb"}], [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], [{"role": "user", "content": None}], [{"role": None, "content": "user"}]
    df = spark.createDataFrame([(x,) for x in one], f"t {N.TURNS}")
    assert df.select(T.content_hash(F.col("t"))).distinct().count() == len(one)


def test_languages_in_the_jvm_and_in_python(spark):
    texts = ["the house is not as old", "das Haus ist nicht alt", "el perro y la casa", "le chat est dans la maison", "o gato não está em casa", "", None, "xyz", "the das el le o", " \n ", "The HOUSE\nis\tnot\u3000as old"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    b = lang.FunctionWords()
    assert [r[0] for r in df.select("i", lang.language(F.col("t")).alias("l")).orderBy("i").select("l").collect()] == [lang.identify(t, b) for t in texts]


def test_redact_by_hand(spark):
    df = spark.createDataFrame([([{"role": "user", "content": "x [EMAIL] x"}, {"role": "assistant", "content": "x"}],)], f"t {N.TURNS}")
    text = lambda turn, s: [t["content"] for t in df.select(lifecycle.redact_by_hand(F.col("t"), F.lit(turn), F.lit(s)).alias("t")).first()["t"]]
    assert text(0, "x") == ["[REDACTED] [EMAIL] [REDACTED]", "x"]
    assert text(0, "[EMAIL]") == ["x [EMAIL] x", "x"] and text(0, "") == ["x [EMAIL] x", "x"]


def test_rates(spark):
    df = spark.createDataFrame([("a", TS + dt.timedelta(minutes=m), m) for m in range(0, 120, 10)] + [("b", None, 999), (None, TS, 1000)], "key string, ts timestamp, n int")
    c = {(r["key"], r["window_start"].hour): (r["allowed"], r["rejected"]) for r in rates.over_limit(rates.windowed(df, "ts", "hour", "key"), 4).collect()}
    assert c == {("a", 0): (4, 2), ("a", 1): (4, 2), (None, 0): (1, 0)}
    assert rates.cooldown(df.where("key = 'a'"), "key", "ts").where("cooling").count() == 6
    days = spark.createDataFrame([("a", TS + dt.timedelta(days=d), d) for d in (0, 10, 35, 70, 100)], "key string, ts timestamp, n int")
    assert sorted(r["n"] for r in rates.ttl_first(days, ["key"], "ts", "n").collect()) == [0, 70]
    assert {r["key"]: r["tier"] for r in rates.decay(df.where("key is not null"), "key", F.col("n") == 10).collect()} == {"a": 1, "b": 3}


def test_audit(spark):
    df = spark.createDataFrame([("a", "mail x@y.example at 10.1.2.3 or 300.1.1.1 or 127.0.0.1 [NAME_1]"), ("b", None), ("c", "")], "id string, text string")
    r = {x["id"]: x for x in audit.audit(df, "id", "text").collect()}
    assert r["a"]["leaks"] == {"email": ["x@y.example"], "ip_address": ["10.1.2.3"]} and r["a"]["placeholder_count"] == 1
    assert r["b"]["leaks"] == {} and r["b"]["density"] == 0 and r["c"]["word_count"] == 0
    assert tuple(audit.rollup(audit.audit(df, "id", "text")).first()) == (3, 1, 0)


def test_names(spark):
    df = spark.createDataFrame([(1, "Orla met Bram. ORLA? orla Bram, Orla and Python"), (2, None)], "id int, text string")
    r = {x["id"]: x for x in ner.scrub_names(df, "text", ner.Gazetteer(("Orla", "Bram", "Python"))).collect()}
    assert r[1]["scrubbed"] == "[NAME_1] met [NAME_2]. ORLA? orla [NAME_2], [NAME_1] and Python" and r[1]["entities"] == 4
    assert r[2]["scrubbed"] is None and r[2]["entities"] == 0


def test_scores(spark):
    cases = spark.createDataFrame([("a", "call Ann now", [("name", "Ann", 5, 8)], []), ("a", "x", [("name", "y", 0, 1)], ["q"])], scoring.CASE)
    assert sorted((r["id"], r["problem"]) for r in scoring.problems(cases).collect()) == [("a", "guard"), ("a", "offset"), ("a", "repeated")]
    f = spark.createDataFrame([("a", 7, 9), ("b", 0, 3)], "id string, start int, end int")
    assert scoring.overlaps(f, cases.limit(1)).count() == 1


def test_corpus_scores_against_a_loop(spark):
    got = scoring.score(corpus.frame(spark), scrub.scrub_udf("input")).first()
    cases = [(i, x, scrub.scrub(x), s, g) for i, x, s, g in corpus.CASES]
    hits = [(i, v) for i, _, out, s, _ in cases for _, v in s if v not in out]
    bad = [i for i, x, out, s, g in cases if g and ((not s and out != x) or any(y not in out for y in g))]
    assert (got["hits"], got["false_positives"]) == (len(hits), len(bad))
    assert got["total"] == sum(len(s) for _, _, _, s, _ in cases) and len(cases) == 58
    # names and places need a model; all else is caught
    missed = {i.split("-")[0] for i, _, out, s, _ in cases for _, v in s if v in out}
    assert missed <= {"name", "place"} and bad == ["code-4"], (missed, bad)  # a slice "[::2]" is read as an address
    with_names = scoring.score(corpus.frame(spark), F.lit("")).first()
    assert with_names["hits"] == with_names["total"]


def test_routes_and_ladder(spark):
    df = spark.createDataFrame([(200,), (422,), (429,), (500,)], "status int")
    assert [tuple(r["r"]) for r in df.select(lifecycle.route(F.col("status")).alias("r")).collect()] == [("ok", "continue"), ("rejected", "isolate"), ("rate_limited", "stop"), ("error", "stop")]
    assert df.select(lifecycle.backoff_seconds(F.lit(20)).alias("s")).first()["s"] == 300
    scores = spark.createDataFrame([(0.86, 0.9), (0.2, 0.81), (0.85, 0.8), (None, None)], "toxicity double, threat double")
    assert [r[0] for r in scores.select(N.ladder({c: F.col(c) for c in scores.columns})).collect()] == ["ml_toxicity", "ml_threat", None, None]
