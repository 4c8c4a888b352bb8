"""Readers of the six formats, the trees, the importer and the streams."""

import datetime as dt
import json
import sqlite3
import zipfile

from pyspark.sql import functions as F

from turnmill.sources import formats, importer, sinks, trees
from turnmill.streaming import windows


def rows(df):
    return sorted(((r["format"], r["conv_no"], r["turns"] and [(t["role"], t["content"]) for t in r["turns"]], bool(r["error"])) for r in df.collect()), key=str)


def test_messages_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("\n".join([json.dumps({"messages": [{"role": "user", "content": "hé"}, {"role": "assistant", "content": ["x"]}, {"role": "assistant", "content": "yo"}]}), "", "{bad", json.dumps({"other": 1})]))
    assert formats.detect_format(str(p)) == "messages_jsonl"
    got = [(t, e) for _, _, t, e in rows(formats.read_export(spark, str(p)))]
    assert sorted(got, key=str) == sorted([([("user", "hé"), ("assistant", "yo")], False), (None, True), (None, True)], key=str)


def test_sharegpt(spark, tmp_path):
    conv = [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}, {"from": "gpt", "value": ""}]
    p = tmp_path / "s.json"
    p.write_text(json.dumps([{"conversations": conv}, {"conversation": conv}, {"x": 1}]))
    assert formats.detect_format(str(p)) == "sharegpt"
    assert [(t, e) for _, _, t, e in rows(formats.read_export(spark, str(p)))] == [([("user", "q"), ("assistant", "a")], False)] * 2 + [(None, True)]
    q = tmp_path / "s.jsonl"
    q.write_text(json.dumps({"conversations": conv}) + "\n{bad\n")
    assert len(rows(formats.read_export(spark, str(q)))) == 2


def node(parent, role, *parts):
    return {"parent": parent, "message": {"author": {"role": role}, "content": {"parts": list(parts)}} if role else None}


TREE = {"r": node(None, None), "a": node("r", "user", "q1", {"x": 1}, "q2"), "b": node("a", "assistant", " a1 "), "c": node("a", "assistant", "other"), "d": node("b", "user", " "), "e": node("d", "assistant", "end")}


def test_zips(spark, tmp_path):
    for name, value in (("tree", [{"mapping": TREE}, {"mapping": 5}]), ("flat", [{"chat_messages": [{"sender": "human", "text": " q "}, {"sender": "assistant", "text": "a"}, {"sender": "x", "text": "y"}]}])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("conversations.json", json.dumps(value))
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    assert formats.detect_format(str(tmp_path / "tree.zip")) == "zip_tree" and formats.detect_format(str(tmp_path / "flat.zip")) == "zip_flat" and formats.detect_format(str(tmp_path / "bad.zip")) is None
    got = rows(formats.read_zip(spark, str(tmp_path / "*.zip")))
    assert ("zip_tree", 0, [("user", "q1\nq2"), ("assistant", "a1"), ("assistant", "end")], False) in got
    assert ("zip_flat", 0, [("user", "q"), ("assistant", "a")], False) in got and sum(e for *_, e in got) == 2


def test_trees():
    assert trees.first_child_path({}) == [] and trees.first_child_path({"a": {"parent": "b", "message": None}, "b": {"parent": "a"}}) == []
    msgs = [{"id": "1", "role": "user", "content": "q", "parentId": None}, {"id": "2", "role": "assistant", "content": "old", "parentId": "1"}, {"id": "3", "role": "assistant", "content": " new ", "parentId": "1"}]
    assert trees.active_branch({"messages": msgs, "history": {"currentId": "3", "messages": {}}}) == [("user", "q"), ("assistant", "new")]
    assert trees.active_branch({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}) == [("user", "a"), ("assistant", "b")]
    assert trees.block_text([{"type": "text", "text": {"value": " a "}}, {"type": "text", "text": "b"}, {"type": "image"}, {"type": "text", "text": " "}]) == "a\nb" and trees.block_text(5) == ""


def test_sqlite_and_threads(spark, tmp_path):
    db = tmp_path / "x.db"
    with sqlite3.connect(db) as c:
        c.execute("create table chat(id text, chat text)")
        c.executemany("insert into chat values (?, ?)", [("1", json.dumps({"messages": [{"role": "user", "content": "q"}]})), ("2", None), ("3", "{bad")])
    assert formats.detect_format(str(db)) == "sqlite_chat"
    assert [(t, e) for _, _, t, e in rows(formats.read_export(spark, str(db)))] == [([("user", "q")], False), (None, True)]
    d = tmp_path / "threads" / "t1"
    d.mkdir(parents=True)
    (d / "messages.jsonl").write_text(json.dumps({"role": "user", "content": [{"type": "text", "text": {"value": "q"}}]}) + "\n" + json.dumps({"role": "assistant", "content": "a"}) + "\n{bad")
    assert formats.detect_format(str(tmp_path / "threads")) == "thread_dir"
    assert rows(formats.read_export(spark, str(tmp_path / "threads"))) == [("thread_dir", 0, [("user", "q"), ("assistant", "a")], True)]


def test_importer(spark):
    good, only = [("user", "q"), ("assistant", "a")], [("user", "q")]
    df = spark.createDataFrame([("f", 1, good), ("f", 2, good), ("f", 3, only), ("f", 4, None)], "file string, conv_no long, turns array<struct<role:string,content:string>>")
    c = importer.classified(df)
    assert tuple(importer.statistics(c).first()) == (1, 1, 1, 1)
    store = c.where("outcome = 'imported'").select("content_hash")
    assert importer.new_only(c, store).count() == 0 and importer.new_only(c, store.limit(0)).count() == 1


def test_streams_equal_batch(spark, tmp_path):
    ts = dt.datetime(2025, 1, 1)
    all_rows = [(i % 7, ts + dt.timedelta(minutes=7 * i), i % 11 == 3) for i in range(60)]
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(all_rows[20 * k : 20 * k + 20], "key long, ts timestamp, bad boolean").coalesce(1).write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema("key long, ts timestamp, bad boolean").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = windows.run(windows.first_within(stream(), ["key"], "ts"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert sorted(r["key"] for r in out.collect()) == list(range(7))
    q = windows.counts(stream(), "ts", "1 hour", "2 hours", "key").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(str(src)).groupBy("key", F.date_trunc("hour", "ts").alias("window_start")).count()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect()))
    tiers = windows.run(windows.tiers(stream(), "key", "bad"), str(tmp_path / "o3"), str(tmp_path / "c3"))
    last = tiers.groupBy("key").agg(F.min("tier").alias("tier"))
    assert {r["key"]: r["tier"] for r in last.collect()} == {k: 1 if any(b for x, _, b in all_rows if x == k) else 3 for k in range(7)}
    live = spark.createDataFrame([("/x/api/chat/", 200), ("/api/chat?a", 204), ("/api/chat", 500), ("/api/chats", 200)], "path string, status int")
    assert windows.captures(live).count() == 2


def test_batches_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2025, 1, 1), None), ("b", dt.datetime(2025, 1, 2), "en")], "id string, at timestamp, language string")
    sinks.write_batches(df, str(tmp_path / "out"), "at")
    lines = [json.loads(r["line"]) for r in sinks.read_uploads(spark, str(tmp_path / "out")).collect()]
    assert sorted((x["id"], x["language"]) for x in lines) == [("a", None), ("b", "en")]
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "x.jsonl").write_text("x" * (sinks.MOST_BYTES + 1))
    assert sinks.read_uploads(spark, str(tmp_path / "big")).count() == 0
    index = spark.createDataFrame([("data/batch_2025-01-01_ab12.jsonl", 1), ("data/other.jsonl", 2)], "file string, n int")
    left, done = sinks.purge_batches(index, index.select("file"))
    assert [r["n"] for r in left.collect()] == [2] and {r["file"]: r["deleted"] for r in done.collect()}["data/other.jsonl"] is False


def test_import_of_several_exports(spark, tmp_path):
    say = lambda q, a: json.dumps({"messages": [{"role": "user", "content": q}, {"role": "assistant", "content": a}]})
    one, two = tmp_path / "one.jsonl", tmp_path / "two.jsonl"
    one.write_text("\n".join([say("q", "a"), say("q", "a"), say("only", ""), "{cut"]))
    two.write_text(say("q", "a") + "\n" + say("x" * (1 << 21), "long"))  # a first line of its own, and one over 2 MiB
    other = tmp_path / "other.bin"
    other.write_text("?")
    paths = [str(one), str(two), str(other), str(tmp_path / "missing.jsonl")]
    r = importer.import_exports(spark, paths)
    new = r.exchanges.collect()
    assert len(new) == 2 and len({x["id"] for x in new}) == 2 and len({x["session_id"] for x in new}) == 2 and all(x["session_id"].startswith("import-") and x["status"] == "raw" for x in new)
    request, response = json.loads(new[0]["request_json"]), json.loads(new[0]["response_json"])
    assert request["messages"][0]["role"] == "user" and response["choices"][0]["message"]["role"] == "assistant"
    stats = {x["file"].rsplit("/", 1)[1]: tuple(x)[1:] for x in r.statistics.collect()}
    assert stats == {"one.jsonl": (1, 1, 1, 1), "two.jsonl": (1, 0, 1, 0)}
    assert len({x["file"] for x in r.errors.collect()}) == 3
    dry = importer.import_exports(spark, paths, dry_run=True)
    assert dry.exchanges is None and sorted(map(tuple, dry.statistics.collect())) == sorted(map(tuple, r.statistics.collect()))
    again = importer.import_exports(spark, paths, store=r.exchanges)
    assert again.exchanges.count() == 0 and {tuple(x)[1:] for x in again.statistics.collect()} == {(0, 1, 2, 1), (0, 0, 2, 0)}


def test_first_lines_of_any_length_are_recognised(tmp_path):
    p = tmp_path / "long.jsonl"
    p.write_text(json.dumps({"messages": [{"role": "user", "content": "é" * (1 << 21)}]}) + "\n", encoding="utf-8")
    assert formats.detect_format(str(p)) == "messages_jsonl"


def test_gzip_level_has_an_effect(spark, tmp_path):
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("text"), F.lit("2025-01-01").alias("day")).coalesce(1)
    sinks.write_batches(df, str(tmp_path / "fast"), "day")
    df.withColumn("date", F.col("day")).write.partitionBy("date").option("compression", "gzip").json(str(tmp_path / "plain"))
    size = lambda d: sum(f.stat().st_size for f in (tmp_path / d).rglob("*.gz"))
    assert size("fast") > size("plain")


def test_update_streams_give_the_last_counts(spark, tmp_path):
    src = tmp_path / "in"
    rows_ = [(dt.datetime(2025, 1, 1, h, m), k) for h in range(3) for m in range(0, 60, 20) for k in ("a", "b", None)]
    df = spark.createDataFrame(rows_, "ts timestamp, key string")
    df.repartition(4).write.parquet(str(src))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    got = windows.run_updates(windows.counts(s, "ts", "1 hour", "5 hours", "key"), str(tmp_path / "out"), str(tmp_path / "check"), ["key", "window_start"])
    assert sorted(((r["key"] or "", r["window_start"].hour, r["n"]) for r in got.collect())) == sorted((k, h, 3) for k in ("", "a", "b") for h in range(3))
