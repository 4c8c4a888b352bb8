"""Conversation exports of six formats as one table: (format, file, conv_no, turns, error).

A file is read by the task that holds it; a conversation that can't be read is a row with ``error`` and null turns, and never stops the others.
Line formats are split by Spark's text reader; formats that are one document a file are read whole.
"""

from __future__ import annotations

import io
import json
import os
import sqlite3
import zipfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from turnmill.functions import native as N
from turnmill.sources.trees import active_branch, block_text, first_child_path

SCHEMA = f"format string, file string, conv_no long, turns {N.TURNS}, error string"
MEMBER, MEMBER_BYTES = "conversations.json", 256 << 20
ROLES = {"human": "user", "gpt": "assistant", "system": "system"}


# ---------------------------------------------------------------- detection


def detect_format(path: str) -> str | None:
    """Name of the format of a file or folder; null if none is recognised."""
    try:
        if os.path.isdir(path):
            inside = [path, *(e.path for e in os.scandir(path) if e.is_dir())]
            return "thread_dir" if any(os.path.exists(os.path.join(d, "messages.jsonl")) for d in inside) else None
        suffix = os.path.splitext(path)[1].lower()
        if suffix == ".zip":
            return _zip_kind(_member(open(path, "rb").read()))
        if suffix in (".db", ".sqlite", ".sqlite3"):
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                return "sqlite_chat" if c.execute("select 1 from sqlite_master where type = 'table' and name = 'chat'").fetchone() else None
        if suffix in (".jsonl", ".json"):
            with open(path, "rb") as f:
                first = next((x for x in f if x.strip()), b"")  # the whole line, however long
            try:
                line = first.decode("utf-8-sig", "strict")
            except UnicodeDecodeError:
                line = first.decode("latin-1")
            return _line_kind(line)
    except (OSError, ValueError, zipfile.BadZipFile, sqlite3.Error, KeyError):
        return None
    return None


def _line_kind(line: str) -> str | None:
    v = json.loads(line)
    if isinstance(v, list):
        v = v[0] if v else None
    if not isinstance(v, dict):
        return None
    if "messages" in v:
        return "messages_jsonl"
    if "conversations" in v or "conversation" in v:
        return "sharegpt"
    return "thread_dir" if "role" in v and isinstance(v.get("content"), list) else None


def _member(data: bytes) -> Any:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        info = z.getinfo(MEMBER)
        if info.file_size > MEMBER_BYTES:
            raise ValueError("member too large")
        with z.open(info) as f:
            raw = f.read(MEMBER_BYTES + 1)
    if len(raw) > MEMBER_BYTES:
        raise ValueError("member too large")
    return json.loads(raw)


def _zip_kind(v: Any) -> str | None:
    first = v[0] if isinstance(v, list) and v and isinstance(v[0], dict) else {}
    return "zip_tree" if "mapping" in first else "zip_flat" if "chat_messages" in first else None


# ---------------------------------------------------------------- parsing, a file or line at a time


def _row(fmt: str, file: str, no: int, turns: list[tuple[str, str]] | None, error: str | None = None) -> tuple:
    return fmt, file, no, None if turns is None else [{"role": r, "content": c} for r, c in turns], error


def _shared(v: dict) -> list[tuple[str, str]] | None:
    c = v.get("conversations", v.get("conversation"))
    if not isinstance(c, list):
        return None
    return [(ROLES[m["from"]], m["value"]) for m in c if isinstance(m, dict) and m.get("from") in ROLES and isinstance(m.get("value"), str) and m["value"]]


def _sharegpt(file: str, text: str) -> Iterator[tuple]:
    try:
        v = json.loads(text)
        items = list(enumerate(v if isinstance(v, list) else [v]))
    except ValueError:
        items = []
        for i, line in enumerate(text.splitlines()):
            if line.strip():
                try:
                    items.append((i, json.loads(line)))
                except ValueError:
                    items.append((i, None))
    for i, v in items:
        t = _shared(v) if isinstance(v, dict) else None
        yield _row("sharegpt", file, i, t, None if t is not None else f"Line {i + 1}: no conversation")


def _zip(file: str, data: bytes) -> Iterator[tuple]:
    try:
        v = _member(data)
        kind = _zip_kind(v)
        if kind is None:
            raise ValueError("no conversations")
    except Exception as e:  # noqa: BLE001 - any broken archive is an error row
        yield _row("zip", file, 0, None, f"{type(e).__name__}: {e}")
        return
    for i, c in enumerate(v):
        try:
            if kind == "zip_tree":
                turns = first_child_path(c["mapping"])
            else:
                who = {"human": "user", "user": "user", "assistant": "assistant"}
                turns = [(who[m["sender"]], t) for m in c["chat_messages"] if m.get("sender") in who and isinstance(m.get("text"), str) and (t := m["text"].strip())]
            yield _row(kind, file, i, turns)
        except Exception as e:  # noqa: BLE001
            yield _row(kind, file, i, None, f"{type(e).__name__}: {e}")


def _thread(file: str, text: str) -> Iterator[tuple]:
    turns, error = [], None
    for i, line in enumerate(text.splitlines()):
        if not line.strip():
            continue
        try:
            m = json.loads(line)
            if m.get("role") in ("user", "assistant") and (t := block_text(m.get("content"))):
                turns.append((m["role"], t))
        except (ValueError, AttributeError):
            error = error or f"Line {i + 1}: no message"
    yield _row("thread_dir", file, 0, turns, error)


def _map(df: DataFrame, parse, content: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [r for f, c in zip(p["file"], p[content], strict=True) for r in parse(f, c)]
            yield pd.DataFrame(rows, columns=["format", "file", "conv_no", "turns", "error"])

    return df.select("file", content).mapInPandas(run, SCHEMA)


# ---------------------------------------------------------------- readers


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))


def read_messages_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A conversation a line, parsed by the JVM. Turns need a role and a content that is a non-empty string. Blank lines don't count; conv_no orders the lines of a file but may have gaps."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % F.lit(1 << 33)).alias("conv_no"), F.trim("value").alias("v")).where("v <> ''")
    v = F.try_parse_json("v")
    kind = F.schema_of_variant(F.variant_get(v, "$.messages", "variant"))
    items = F.from_json("v", "struct<messages:array<string>>")["messages"]
    string = lambda m, k: F.when(F.schema_of_variant(F.variant_get(F.try_parse_json(m), f"$.{k}", "variant")) == "STRING", F.get_json_object(m, f"$.{k}"))
    turns = F.filter(F.transform(items, lambda m: F.struct(string(m, "role").alias("role"), string(m, "content").alias("content"))), lambda t: (F.coalesce(t["role"], F.lit("")) != "") & (F.coalesce(t["content"], F.lit("")) != ""))
    good = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
    return lines.select(F.lit("messages_jsonl").alias("format"), "file", "conv_no", F.when(good, turns).alias("turns"), F.when(~good, F.lit("Line: no messages")).alias("error"))


def read_sharegpt(spark: SparkSession, path: str) -> DataFrame:
    return _map(_whole(spark, path), _sharegpt, "value")


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """Archives with a tree or flat export; which of them decides each archive."""
    return _map(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"), _zip, "content")


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """A file messages.jsonl a conversation, a message a line, below the path at any depth."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="messages.jsonl")
    return _map(files.withColumn("file", F.col("_metadata.file_path")), _thread, "value")


class SqliteChats(DataSource):
    """spark.read.format("sqlite_chat").option("path", ...): a row a chat of the table chat(id, chat)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_chat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options["path"])


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        names = sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith((".db", ".sqlite", ".sqlite3"))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        file = partition.value
        with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as c:
            for i, (chat_id, chat) in enumerate(c.execute("select id, chat from chat")):
                if chat is None:
                    continue
                try:
                    turns = active_branch(json.loads(chat))
                    yield "sqlite_chat", file, i, turns, None
                except (ValueError, AttributeError, TypeError):
                    yield "sqlite_chat", file, i, None, f"Row {chat_id}: no chat"


def read_sqlite(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SqliteChats)
    return spark.read.format("sqlite_chat").option("path", path).load()


READERS = {"messages_jsonl": read_messages_jsonl, "sharegpt": read_sharegpt, "zip_tree": read_zip, "zip_flat": read_zip, "sqlite_chat": read_sqlite, "thread_dir": read_threads}


def read_export(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Conversations of a file or folder; a folder of no format of its own is read file by file. Raises ValueError if nothing is recognised."""
    kind = format or detect_format(path)
    if kind:
        return READERS[kind](spark, path)
    parts = []
    if os.path.isdir(path):
        for e in sorted(os.scandir(path), key=lambda e: e.name):
            try:
                parts.append(read_export(spark, e.path))
            except ValueError:
                continue
    if not parts:
        raise ValueError(f"unknown format: {path}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
