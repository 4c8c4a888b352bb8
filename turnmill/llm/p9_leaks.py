"""Problem 9: evaluation texts in training text, by CGK embedding and bit-sampling LSH.

A window of W words is embedded by the CGK random walk: at each step it outputs the word it stands on and, by a random bit of the step and the
word, moves on or stays. Windows that are k word edits apart fall into step again after each edit, so their outputs differ in few places (Hamming
distance O(k^2); equal windows differ in none). A key is SAMPLE of the outputs, taken at random steps; windows with equal keys are
candidates. Steps are sampled within the first STEPS * W only: there even the fastest walks have seldom come to the window's end, behind which
outputs tell nothing; a walk that has is given its length as output.

The number of repetitions (walk and sample) is fitted, not assumed: walks over random windows with random edits are keyed until the share of them found
reaches the target recall (``repetitions``; fixed seeds). With no edits a single repetition finds all.

Windows start at every word of each item and of each document. A document's window drops out of a walk as soon as its outputs so far are no
prefix of any item window's sample. Candidates of all repetitions are gathered; a pair of document and item is verified window pair by window pair, each once,
and no further once one has been verified. The check is exact: the edit distance of the words, in bands, for all pairs at once.

``window=None`` takes windows as long as the item (items from MIN_WINDOW to MOST_WINDOW words; longer ones are cut into windows of about that many, shorter
ones are not looked for). The number of edits is then ``edit_share`` of the window's words.

The items are held in memory on every worker, at most BLOCK_WORDS words of them at a time: more items are run in blocks.

Results: (doc_id, item_id) once each. Null ids and null or short texts give none; ties and repeated rows come once; empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.texts import mix, word_arrays

WINDOW = 12
SAMPLE = 4
#: Sampled steps lie within STEPS * W; a walk moves on in every other step on average.
STEPS = 1.5
BLOCK_WORDS = 2_000_000
MIN_WINDOW, MOST_WINDOW = 12, 48
MOST_REPEATS = 64


def plan(window: int, sample: int, repeats: int, seed: int = 20240) -> list[tuple[int, np.ndarray]]:
    """For each repetition the seed of its walk and the sorted steps it samples: one early, by which most windows drop out, and others anywhere. Fixed by the arguments."""
    rng = np.random.default_rng(seed)
    early = max(1, window // 6)
    return [(int(rng.integers(1 << 62)), np.sort(np.append(rng.integers(early), early + rng.choice(int(STEPS * window) - early, sample - 1, replace=False)))) for _ in range(repeats)]


def walk(words: np.ndarray, starts: np.ndarray, window: int, seed: int, steps: np.ndarray, prefixes: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """LSH keys of the windows at ``starts``, the index of each window left, and the sorted keys after each sampled step. With ``prefixes`` windows whose key so far isn't among them are dropped."""
    left = np.arange(len(starts))
    at = np.zeros(len(starts), np.int64)
    key = np.zeros(len(starts), np.uint64)
    base, found, k = starts, [], 0
    for j in range(int(steps[-1]) + 1):
        out = words[np.minimum(base + np.minimum(at, window - 1), len(words) - 1)]
        if j == steps[k]:
            key = mix(key + np.where(at < window, out, np.uint64(j)) + np.uint64(j + 1))
            if prefixes is None:
                found.append(np.unique(key))
            else:
                table = prefixes[k]
                ok = table[np.minimum(np.searchsorted(table, key), len(table) - 1)] == key
                left, at, key, base, out = left[ok], at[ok], key[ok], base[ok], out[ok]
            k += 1
        # bit j of the walk: moves on or stays
        at = at + (mix(out + np.uint64(seed) + np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return key, left, found


@functools.lru_cache(maxsize=256)
def repetitions(window: int, edits: int, sample: int, recall: float, trials: int = 3000) -> int:
    """Repetitions that find ``recall`` of random windows with ``edits`` random word edits each (changed, dropped, put in). At most MOST_REPEATS."""
    if edits == 0:
        return 1
    rng = np.random.default_rng(77)
    x = rng.integers(0, 1 << 62, (trials, window), dtype=np.uint64)
    y = np.zeros_like(x)
    for i in range(trials):
        w = x[i].tolist()
        for _ in range(edits):
            j, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w[j : j + (kind != 2)] = [] if kind == 1 else [int(rng.integers(1 << 62))]
        y[i] = (w + rng.integers(0, 1 << 62, window, dtype=np.uint64).tolist())[:window]
    starts = np.arange(trials) * window
    missed = np.ones(trials, bool)
    for r, (seed, steps) in enumerate(plan(window, sample, MOST_REPEATS), 1):
        missed &= walk(x.ravel(), starts, window, seed, steps, None)[0] != walk(y.ravel(), starts, window, seed, steps, None)[0]
        if missed.mean() <= 1 - recall:
            return r
    return MOST_REPEATS


def _starts(ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.diff(ends) - window + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return ends[:-1][owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), owner


def within(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Whether the edit distance of each two rows of words (pairs, window) is at most ``most``: bands of 2 * most + 1 diagonals, all pairs at once."""
    if most == 0:
        return (x == y).all(1)
    n, w = x.shape
    far = most + 1
    # row i of the table, diagonals j - i from -most to most
    d = np.full((n, 2 * most + 3), far, np.int32)
    d[:, most + 1 : 2 * most + 2] = np.arange(most + 1)
    padded = np.concatenate((np.zeros((n, most), np.uint64), y, np.zeros((n, most), np.uint64)), 1)
    for i in range(1, w + 1):
        new = np.full_like(d, far)
        for b in range(2 * most + 1):
            j = i + b - most
            if not 0 <= j <= w:
                continue
            if j == 0:
                new[:, b + 1] = min(i, far)
                continue
            differs = x[:, i - 1] != padded[:, j - 1 + most]
            new[:, b + 1] = np.minimum(np.minimum(d[:, b + 1] + differs, d[:, b + 2] + 1), np.minimum(new[:, b] + 1, far))
        d = new
    return d[:, most + 1] <= most


class Items:
    """Item windows of one length and their keys for each repetition."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, starts: np.ndarray, owner: np.ndarray, window: int, edits: int, sample: int, recall: float):
        self.window, self.edits, self.ids = window, edits, ids
        self.words, self.starts, self.owner = words, starts, owner
        self.plans = []
        for seed, steps in plan(window, sample, repetitions(window, edits, sample, recall)):
            if len(starts):
                key, _, prefixes = walk(words, starts, window, seed, steps, None)
                order = np.argsort(key, kind="stable")
                self.plans.append((seed, steps, key[order], order, prefixes))

    def search(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, item) of which some windows are at most ``edits`` apart."""
        starts, owner = _starts(ends, self.window)
        found = np.empty(0, np.int64)
        for seed, steps, keys, order, prefixes in self.plans:
            key, left, _ = walk(words, starts, self.window, seed, steps, prefixes)
            if not len(key):
                continue
            # windows of an item with the same key and the same words are one
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            total = np.cumsum(hi - lo)
            for a in range(0, int(total[-1]), 200_000):
                some = slice(np.searchsorted(total, a, "right"), np.searchsorted(total, a + 200_000, "right"))
                n = (hi - lo)[some]
                doc = np.repeat(left[some], n)
                item = order[np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                pair = (owner[doc] << 32) | self.owner[item]
                ok = ~np.isin(pair, found)  # a pair that has been verified is not verified again
                doc, item, pair = doc[ok], item[ok], pair[ok]
                for lo_ in range(0, len(doc), 20_000):
                    d, i, p = doc[lo_ : lo_ + 20_000], item[lo_ : lo_ + 20_000], pair[lo_ : lo_ + 20_000]
                    at = np.arange(self.window)
                    good = within(words[starts[d][:, None] + at], self.words[self.starts[i][:, None] + at], self.edits)
                    found = np.union1d(found, p[good])
        return found >> 32, found & 0xFFFFFFFF


def indexed(ids: list[int], texts: list[str], window: int | None, edits: int, edit_share: float, sample: int, recall: float) -> list[Items]:
    """The items' windows, a table for each window length."""
    words, ends = word_arrays(texts)
    number = np.array(ids, np.int64)
    if window is not None:
        starts, owner = _starts(ends, window)
        return [Items(number, words, starts, owner, window, edits, sample, recall)]
    by: dict[int, list[tuple[int, int]]] = {}
    for i, n in enumerate(np.diff(ends).tolist()):
        if n < MIN_WINDOW:
            continue
        # one window as long as the item, or several of nearly equal length that cover it; lengths are multiples of four, so that there are few tables
        count = -(-n // MOST_WINDOW)
        w = max(MIN_WINDOW, n // count // 4 * 4)
        for s in np.unique(np.linspace(0, n - w, count).astype(int)).tolist():
            by.setdefault(w, []).append((int(ends[i]) + s, i))
    return [Items(number, words, np.array([s for s, _ in x]), np.array([i for _, i in x]), w, max(1, round(edit_share * w)), sample, recall) for w, x in sorted(by.items())]


def leaks(documents: DataFrame, items: DataFrame, window: int | None = WINDOW, edits: int = 0, recall: float = 0.95, sample: int = SAMPLE, edit_share: float = 0.1) -> DataFrame:
    """(doc_id, item_id): the document has a window of ``window`` words that is at most ``edits`` word edits from one of the item; without ``window``, one of the item's size and ``edit_share``."""
    spark = documents.sparkSession
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").distinct().toLocalIterator():
        if size > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((r["item_id"], r["text"]))
        size += len(r["text"]) // 4
    found = None
    for block in blocks:
        block.sort()
        shared = spark.sparkContext.broadcast(indexed([i for i, _ in block], [t for _, t in block], window, edits, edit_share, sample, recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    p = b.slice(lo, 1000)
                    words, ends = word_arrays(p["text"].to_pylist())
                    for table in shared.value:
                        doc, item = table.search(words, ends)
                        yield pa.RecordBatch.from_arrays([p["doc_id"].take(pa.array(doc)), pa.array(table.ids[item])], ["doc_id", "item_id"])

        part = documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long")
        found = part if found is None else found.unionByName(part)
    return found.distinct()
