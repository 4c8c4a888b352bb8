"""Entities behind an interface: a backend finds them, the operators apply thresholds, the allow list and numbered placeholders.

No model is shipped: ``Gazetteer`` finds known names and says so by has_model = False.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.functions import patterns as P
from turnmill.functions.scrub import redact_pii, reduce_urls, normalise, scrub_secrets

ENTITIES = "array<struct<entity_type:string,start:int,end:int,score:double>>"


class Backend(Protocol):
    has_model: bool

    def find(self, text: str) -> list[tuple[str, int, int, float]]: ...


@dataclass(frozen=True)
class Gazetteer:
    """PERSON for runs of known names."""

    names: tuple[str, ...]
    has_model: bool = False

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        return [("PERSON", m.start(), m.end(), 1.0) for m in _pattern(self.names).finditer(text)] if self.names else []


@lru_cache(maxsize=4)
def _pattern(names: tuple[str, ...]) -> re.Pattern:
    """Runs of names, compiled once a worker."""
    one = "(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")"
    return re.compile(rf"\b{one}(?: {one})*\b")


@dataclass(frozen=True)
class Nothing:
    """The backend of a chain without entities."""

    has_model: bool = False

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        return []


def backend(model: Backend | None = None, names: tuple[str, ...] = ()) -> Backend:
    """The backend to use: a model if there is one, else the known names, else none."""
    return model or (Gazetteer(tuple(sorted(names))) if names else Nothing())


TAGS = {"PERSON": "NAME", "LOCATION": "LOCATION", "DATE_TIME": "DATE", "NRP": "GROUP"}


def accept(found: list[tuple[str, int, int, float]], text: str) -> list[tuple[str, int, int, float]]:
    """Entities over the threshold of their type and not on the allow list; of overlapping ones the earlier, then the longer."""
    allowed = {w.lower() for w in P.ALLOWED}
    ok = sorted((f for f in found if f[3] >= P.ENTITY_SCORES.get(f[0], P.ENTITY_SCORE) and text[f[1] : f[2]].lower() not in allowed and f[0] in TAGS), key=lambda f: (f[1], -f[2]))
    out: list[tuple[str, int, int, float]] = []
    for f in ok:
        if not out or f[1] >= out[-1][2]:
            out.append(f)
    return out


def redact(text: str, backend: Backend) -> tuple[str, int]:
    """The text with names numbered by first appearance (case and spacing aside) and other entities tagged, and their number; then the structured patterns as a net."""
    t = scrub_secrets(reduce_urls(normalise(text)))
    numbers: dict[str, int] = {}
    out, at = [], 0
    found = accept(backend.find(t), t)
    for kind, a, z, _ in found:
        if kind == "PERSON":
            key = " ".join(t[a:z].casefold().split())
            new = f"[NAME_{numbers.setdefault(key, len(numbers) + 1)}]"
        else:
            new = f"[{TAGS[kind]}]"
        out += (t[at:a], new)
        at = z
    return redact_pii("".join([*out, t[at:]])), len(found)


def scrub_names(df: DataFrame, text: str, backend: Backend) -> DataFrame:
    """df with ``scrubbed`` and ``entities``; null texts stay null, with 0 entities."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            done = [redact(t, backend) if isinstance(t, str) else (None, 0) for t in p[text]]
            p["scrubbed"], p["entities"] = [d[0] for d in done], [d[1] for d in done]
            yield p

    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", scrubbed string, entities long").withColumn("entities", F.col("entities").cast("int"))


#: The entities of the service, the turns it takes at once, and the characters it looks at in a turn.
SERVER_TYPES, SERVER_TURNS, SERVER_CHARS = ("PERSON", "LOCATION"), 200, 100_000


def redact_turn(text: str | None, backend: Backend, chars: int | None = None) -> tuple[str | None, int]:
    """A turn with its entities of SERVER_TYPES tagged, and their number. ``chars``: only so many characters are looked at, the rest is attached as it is. If the backend fails, the turn passes as it is."""
    if text is None:
        return None, 0
    t = normalise(text)
    head, tail = (t, "") if chars is None else (t[:chars], t[chars:])
    try:
        found = [f for f in accept(backend.find(head), head) if f[0] in SERVER_TYPES]
    except Exception:  # noqa: BLE001 - a failing model must not lose the turn
        return t, 0
    numbers: dict[str, int] = {}
    out, at = [], 0
    for kind, a, z, _ in found:
        key = " ".join(head[a:z].casefold().split())
        out += (head[at:a], f"[NAME_{numbers.setdefault(key, len(numbers) + 1)}]" if kind == "PERSON" else f"[{TAGS[kind]}]")
        at = z
    return "".join([*out, head[at:], tail]), len(found)


def scrub_turns(df: DataFrame, turns: str, backend: Backend, chars: int | None = None, most: int | None = None) -> DataFrame:
    """df with ``turns`` redacted, ``entities_per_turn`` and their sum ``entities``. Whole conversations go to the workers in Arrow batches, so nothing is flattened and put together again.

    ``most``: turns beyond are cut off (a service that takes SERVER_TURNS at once does that); by default all are kept, and whole. Null turns have no entities.
    """

    @F.pandas_udf("array<struct<content:string,n:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda xs: None if xs is None else [dict(zip(("content", "n"), redact_turn(x, backend, chars), strict=True)) for x in xs])

    t = F.col(turns) if most is None else F.slice(turns, 1, most)
    d = df.withColumn(turns, t).withColumn("_done", run(F.transform(turns, lambda x: x["content"])))
    d = d.withColumn(turns, F.zip_with(turns, "_done", lambda a, b: F.struct(a["role"].alias("role"), b["content"].alias("content"))))
    counts = F.coalesce(F.transform("_done", lambda x: x["n"]), F.array().cast("array<int>"))
    return d.withColumn("entities_per_turn", counts).withColumn("entities", F.aggregate("entities_per_turn", F.lit(0), lambda a, x: a + x)).drop("_done")
