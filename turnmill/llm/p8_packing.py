"""Problem 8: texts into containers of fixed capacity, balanced by estimated attention cost.

A text of s tokens costs LINEAR s + QUADRATIC s^2 (attention within the text only). Texts larger than the capacity are
cut into full pieces and a rest; nothing else is split. Texts are dealt at random, by their id, into groups of about GROUP; in a group
they are taken in descending order, and each goes to the container of the lowest cost so far among those with room. The number of
containers starts from the tokens and grows only by what finds no room. The least filled containers of all groups are
dealt and packed once more, together, in groups of the same size.

Sizes are tokens of a public tokenizer whose vocabulary file is a parameter; each text is tokenized once, whole, for all capacities.

Results: a row a piece: (pack_id, capacity, doc_id, copy, piece from 0, tokens, container). Null and empty texts have no tokens and
take part with a piece of 0 tokens, so that each document is assigned. Repeated doc_ids are packed one by one, told apart by ``copy``. Null
capacities and capacities below 1 give no rows; empty tables give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of the vocabulary file
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
GROUP = 4000
FIT = 2
#: Containers filled below this share are packed once more.
LOW = 0.97

_encoders: dict = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _encoders[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item (sizes at most the capacity), and the cost of each container.

    Descending items go to the cheapest container with room; containers that would be left more than half empty
    (a FIT-th of the capacity) come after all others, without which the large texts' gaps stay open. An item without room opens a container.
    """
    n = len(sizes)
    out = np.full(n, -1, np.int64)
    used = max(1, -(-int(sizes.sum()) // capacity))
    room = np.full(used + n, capacity, np.int64)
    cost = np.zeros(used + n)
    step = max(1, capacity // FIT)
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        left = room[:used] - s
        c = int(np.argmin(np.where(left >= 0, cost[:used] + 1e12 * (left // step), np.inf)))
        if left[c] < 0:
            c = used
            used += 1
        out[i] = c
        room[c] -= s
        cost[c] += LINEAR * s + QUADRATIC * s * s
    return np.unique(out, return_inverse=True)[1], cost[:used]


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, copy, tokens): copy tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                p = b.slice(lo, 1000)
                n = [len(enc.encode_ordinary(t)) if t else 0 for t in p["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([p["doc_id"], p["copy"], pa.array(n, pa.int64())], ["doc_id", "copy", "tokens"])

    return documents.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("copy"), "text").mapInArrow(run, "doc_id long, copy long, tokens long")


ITEM = "pack_id long, capacity long, doc_id long, copy long, piece int, tokens long"


def _packed(items: DataFrame, groups: int) -> DataFrame:
    """items (ITEM and grp) with container (within pack and group) and its fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        pack_id, grp, cap, size = (t[x].to_numpy() for x in ("pack_id", "grp", "capacity", "tokens"))
        # ties in a fixed order, so that a lost task gives the same containers again
        order = np.lexsort((t["piece"].to_numpy(), t["copy"].to_numpy(), -size, grp, pack_id))
        t = t.take(pa.array(order))
        pack_id, grp, cap, size = pack_id[order], grp[order], cap[order], size[order]
        cut = np.concatenate((np.flatnonzero(np.concatenate(([True], (pack_id[1:] != pack_id[:-1]) | (grp[1:] != grp[:-1])))), [len(size)]))
        container, fill = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            c, _ = pack(size[a:z], int(cap[a]))
            container[a:z] = c
            fill[a:z] = np.bincount(c, weights=size[a:z]).astype(np.int64)[c]
        t = t.append_column("container", pa.array(container)).append_column("fill", pa.array(fill))
        yield from t.to_batches()

    schema = pa.schema([("pack_id", pa.int64()), ("capacity", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int64()), ("grp", pa.int32())])
    by = F.pmod(F.xxhash64("pack_id", "grp"), F.lit(groups)).cast("int")
    df = items.select(*(f.split()[0] for f in ITEM.split(", ")), "grp")
    df = df.repartitionById(groups, by) if hasattr(df, "repartitionById") else df.repartition(groups, by)
    return df.mapInArrow(run, f"{ITEM}, grp int, container long, fill long")


def packing(documents: DataFrame, pack_sizes: DataFrame, path: str = TOKENIZER) -> DataFrame:
    spark = documents.sparkSession
    sizes = written(sized(documents, path), "sizes")
    packs = pack_sizes.where("pack_id is not null and capacity >= 1").groupBy(F.col("pack_id").cast("long")).agg(F.min("capacity").cast("long").alias("capacity"))
    # full pieces of what is too large, then the rest
    pieces = sizes.crossJoin(F.broadcast(packs)).withColumn("full", (F.col("tokens") / F.col("capacity")).cast("long")).withColumn("rest", F.col("tokens") - F.col("full") * F.col("capacity"))
    last = pieces.where("rest > 0 or full = 0").select("pack_id", "capacity", "doc_id", "copy", F.col("full").cast("int").alias("piece"), F.col("rest").alias("tokens"))
    full = pieces.where("full > 0").select("pack_id", "capacity", "doc_id", "copy", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("piece"), F.col("capacity").alias("tokens"))
    n = sizes.count()
    groups = max(1, n // GROUP)
    few = spark.sparkContext.defaultParallelism
    dealt = last.withColumn("grp", F.pmod(F.xxhash64("copy", "doc_id"), F.lit(groups)).cast("int"))
    one = written(_packed(dealt, max(1, min(3 * groups, 4 * few) if groups < few else 3 * groups)), "packed")
    kept = one.where(F.col("fill") >= LOW * F.col("capacity"))
    low = one.where(F.col("fill") < LOW * F.col("capacity"))
    again = max(1, low.count() // GROUP)
    two = _packed(low.drop("container", "fill").withColumn("grp", F.pmod(F.xxhash64("copy", F.lit(7)), F.lit(again)).cast("int")), max(1, min(3 * again, 4 * few) if again < few else 3 * again))
    name = lambda kind: F.concat_ws("-", F.lit(kind), "grp", "container")
    rows = (
        full.select("pack_id", "capacity", "doc_id", "copy", "piece", "tokens", F.concat_ws("-", F.lit("f"), "copy", "piece").alias("container"))
        .unionByName(kept.select("pack_id", "capacity", "doc_id", "copy", "piece", "tokens", name("a").alias("container")))
        .unionByName(two.select("pack_id", "capacity", "doc_id", "copy", "piece", "tokens", name("b").alias("container")))
    )
    return rows


def report(assignment: DataFrame) -> DataFrame:
    """Containers, tokens and unused share of each capacity."""
    per = assignment.groupBy("pack_id", "capacity", "container").agg(F.sum("tokens").alias("used"))
    return per.groupBy("pack_id", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (1 - F.sum("used") / (F.count("*") * F.first("capacity"))).alias("unused_share"))
