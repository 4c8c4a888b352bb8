"""Problem 4: languages of turns and of their sentences, by a string kernel.

The kernel of two sentences is the blended spectrum of presence: the number of distinct 1-, 2- and 3-grams of letters in both, normalised. Training sentences
(a bounded sample, at most TRAIN_ROWS records a stated language, taken by the hash of the id; their labels are the stated languages, errors
included) are mapped to Nyström features of LANDMARKS landmark sentences, and one-versus-rest kernel ridge regression is fitted on them. Sentences that it contradicts
are taken for mislabelled, left out, and it is fitted once more. As the kernel is an inner product, the landmarks' expansion is summed up to
one weight a gram and language; a batch of sentences is scored as the product of its presence matrix (sparse) with these weights.

Only sentences of at least MIN_WORDS words are scored; code, list entries, rows of cells, data records and text without letters have no language. The
confidence is the softmax of the scores at SHARPNESS. A language other than the one that most of the turn holds needs a margin.

Results: a row a turn and language in ``segments``; ``found``: (staged_id, turn_no, lang) of languages not stated. Null, empty, unknown and und state
none. Records that don't parse or without id give none; repeated ids give each row once; an empty table gives no rows. Without any stated
language there is nothing to learn from, and no rows come out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm import stopwords
from turnmill.llm.p3_quality import ENTRY, FENCE, is_cells
from turnmill.llm.texts import codes_of, turns_of, word_arrays

LANGUAGES = stopwords.LANGUAGES
MIN_WORDS = 6
TRAIN_ROWS = 400
TRAIN_SENTENCES = 900
LANDMARKS = 100
RIDGE = 1e-3
SHARPNESS = 6.0
#: Least score of the best language, or its least lead over the next, for a sentence to count; and its lead over the turn's main language.
LEAST, LEAD = 0.1, 0.25

SENTENCE = re.compile(r"[.?!…][\"'”»)\]]*\s+")
RECORD = re.compile(r"^\s*[{\[<]|[}\]>]\s*$|^\s*[\w.+-]+@\S+,|^\S*[=;{}]\S*$")

#: Letters that have a place of their own; all else is a gap.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäçèéêëìíîïñòóôõöùúûüýÿßœæ"
GRAMS = 64**3
GAP = 63


def _tables() -> tuple[np.ndarray, np.ndarray]:
    place, alnum = np.zeros(0x3100, np.int64), np.zeros(0x3100, bool)
    for c in range(0x3100):
        i = LETTERS.find(chr(c).lower()[0])
        place[c] = i + 1
        alnum[c] = chr(c).isalnum()
    return place, alnum


_place: np.ndarray | None = None
_alnum: np.ndarray | None = None


def grams(sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of the sentences with the sentence of each, and the number of words of each sentence."""
    global _place, _alnum
    if _place is None:
        _place, _alnum = _tables()
    n = len(sentences)
    codes = np.minimum(codes_of("".join(f"\n{s}\n" for s in sentences)), 0x30FF)
    owner = np.repeat(np.arange(n), [len(s) + 2 for s in sentences])
    word = _alnum[codes]
    words = np.bincount(owner[1:][word[1:] & ~word[:-1]], minlength=n)
    c = _place[codes]
    # runs of gaps count as one gap
    keep = (c > 0) | np.concatenate(([True], c[:-1] > 0)) | np.concatenate(([True], owner[1:] != owner[:-1]))
    c, owner = np.where(c[keep] == 0, GAP, c[keep]), owner[keep]
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), words
    inside = owner[2:] == owner[:-2]
    three = _distinct(((owner[:-2] << 18) | (c[:-2] << 12) | (c[1:-1] << 6) | c[2:])[inside])
    two = _distinct((three >> 18 << 18) | ((three >> 6) & 0xFFF))
    one = _distinct((two >> 18 << 18) | ((two >> 6) & 0x3F))
    # no letter has the place 0, so 1-, 2- and 3-grams have places of their own
    key = np.concatenate((three, two, one))
    return key & 0x3FFFF, key >> 18, words


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class Kernel:
    """Weights of the grams, a column a language."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def scores(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores a sentence and language, and the sentences' numbers of words."""
        g, owner, words = grams(sentences)
        n = len(sentences)
        out = np.stack([np.bincount(owner, weights=self.weights[:, k][g], minlength=n) for k in range(len(LANGUAGES))], 1)
        return out / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))[:, None], words


def _presence(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Presence matrix over the grams that occur, rows of length 1, and these grams."""
    g, owner, _ = grams(sentences)
    u, at = np.unique(g, return_inverse=True)
    x = np.zeros((len(sentences), len(u)), np.float32)
    x[owner, at] = 1
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)), u


def fit(sentences: list[str], labels: np.ndarray, seed: int = 7) -> Kernel:
    """Kernel ridge regression on Nyström features; labels index LANGUAGES."""
    rng = np.random.default_rng(seed)
    x, u = _presence(sentences)
    keep = np.ones(len(sentences), bool)
    for _ in range(2):
        rows = np.flatnonzero(keep)
        marks = np.concatenate([rng.permutation(rows[labels[rows] == k])[:LANDMARKS] for k in range(len(LANGUAGES))])
        z = x[marks]
        value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
        ok = value > 1e-6 * value.max()
        root = vector[:, ok] / np.sqrt(value[ok])
        phi = (x[rows] @ z.T) @ root
        y = np.where(labels[rows][:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)
        weight = 1 / np.bincount(labels[rows], minlength=len(LANGUAGES))[labels[rows]]
        beta = np.linalg.solve((phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1]), (phi * weight[:, None]).T @ y)
        collapsed = z.T @ (root @ beta)
        keep = np.argmax(x @ collapsed, 1) == labels
    weights = np.zeros((GRAMS, len(LANGUAGES)))
    weights[u] = collapsed
    return Kernel(weights)


def _long(text: str) -> bool:
    """A first look: whether there are places enough between words; the exact count decides."""
    return text.count(" ") + text.count("'") + text.count("’") + text.count("-") >= MIN_WORDS - 1


def located(text: str) -> list[tuple[int, int]]:
    """Where the sentences of a turn are, without code, lists, tables and data records."""
    if "```" in text:
        text = FENCE.sub(lambda m: "\n" * len(m[0]), text)
    out, at = [], 0
    for line in text.split("\n"):
        if _long(line) and not (ENTRY.match(line) and line.count(" ") <= 14) and not is_cells(line):
            a = 0
            for s in SENTENCE.split(line):
                a = line.index(s, a)
                if _long(s) and not RECORD.search(s):
                    out.append((at + a, at + a + len(s)))
                a += len(s)
        at += len(line) + 1
    return out


def pieces(text: str) -> list[str]:
    return [text[a:z] for a, z in located(text)]


def stated(c) -> F.Column:
    """The stated language: lower case, without suffix; null if it states none."""
    x = F.lower(F.split(F.trim(c), "[-_]", 2)[0])
    return F.when(~x.isin("", "unknown", "und"), x)


def trained(staged: DataFrame) -> Kernel | None:
    """The classifier from a bounded sample of records with a stated language."""
    known = staged.select(stated(F.col("language")).alias("lang"), "id", "scrubbed_turns").where(F.col("lang").isin(*LANGUAGES) & F.col("id").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(int((1 << 62) * min(1.0, TRAIN_ROWS / n))))))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 62)) < share[F.col("lang")]).select("lang", "scrubbed_turns")
    sentences: list[str] = []
    labels: list[int] = []
    for lang, turns in sorted((r["lang"], r["scrubbed_turns"] or "") for r in sample.collect()):  # about TRAIN_ROWS a language
        for _, c in turns_of(turns) or []:
            for s in pieces(c):
                sentences.append(s)
                labels.append(LANGUAGES.index(lang))
    y = np.array(labels, np.int64)
    rng = np.random.default_rng(11)
    take = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:TRAIN_SENTENCES] for k in range(len(LANGUAGES))]) if len(y) else y
    return fit([sentences[i] for i in take], y[take]) if len(take) else None


def segments(staged: DataFrame) -> DataFrame:
    """(staged_id, turn_no, lang, sentences, confidence, stated, start, end): a row a turn and language that it holds; its sentences in it lie between the characters start and end."""
    schema = "staged_id string, turn_no long, lang string, sentences int, confidence double, stated string, start int, end int"
    kernel = trained(staged)
    spark = staged.sparkSession
    if kernel is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((kernel, stopwords.table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, tab = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 400):
                p = b.slice(lo, 400)
                ids, langs = p["id"].to_pylist(), p["stated"].to_pylist()
                texts, turn, places = [], [], []
                for i, t in enumerate(p["scrubbed_turns"].to_pylist()):
                    for j, (_, c) in enumerate(turns_of(t) or []):
                        s = located(c)
                        texts.extend(c[a:z] for a, z in s)
                        places.extend(s)
                        turn.extend([(i, j)] * len(s))
                if not texts:
                    continue
                rows = _decide(texts, turn, places, langs, k, tab)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i, *_ in rows], pa.string()), pa.array([j for _, j, *_ in rows], pa.int64()), pa.array([LANGUAGES[x[2]] for x in rows], pa.string()), pa.array([x[3] for x in rows], pa.int32()), pa.array([x[4] for x in rows], pa.float64()), pa.array([langs[i] for i, *_ in rows], pa.string()), pa.array([x[5] for x in rows], pa.int32()), pa.array([x[6] for x in rows], pa.int32())],
                    ["staged_id", "turn_no", "lang", "sentences", "confidence", "stated", "start", "end"],
                )

    rows = staged.where("id is not null").select("id", "scrubbed_turns", stated(F.col("language")).alias("stated"))
    return rows.mapInArrow(run, schema)


def _decide(texts: list[str], turn: list[tuple[int, int]], places: list[tuple[int, int]], langs: list[str | None], kernel: Kernel, tab: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int, int, float, int, int]]:
    """(record, turn, language, sentences, confidence, start, end) of the languages of each turn."""
    s, words = kernel.scores(texts)
    best = s.argmax(1)
    top = s[np.arange(len(s)), best]
    at = np.array([(i << 32) | j for i, j in turn], np.int64)
    ok = (words >= MIN_WORDS) & ((top > LEAST) | (top - np.partition(s, -2, axis=1)[:, -2] > LEAD))
    u, inv = np.unique(at, return_inverse=True)
    held = np.zeros((len(u), len(LANGUAGES)))
    np.add.at(held, (inv[ok], best[ok]), top[ok])
    main = held.argmax(1)[inv]
    lead = top - s[np.arange(len(s)), main]
    index = {x: i for i, x in enumerate(LANGUAGES)}
    said = np.array([index.get(x, -1) if x else -1 for x in langs])[at >> 32]
    ok &= (best == main) | (lead > LEAD)
    # what is to be reported must also hold function words of its language
    odd = np.flatnonzero(ok & (best != said))
    if len(odd):
        v = stopwords.votes(*word_arrays([texts[i] for i in odd]), tab)
        ok[odd[(v[np.arange(len(odd)), best[odd]] < 0.8) | (v.argmax(1) != best[odd]) & (v.max(1) > v[np.arange(len(odd)), best[odd]] + 1)]] = False
    e = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)))
    conf = 1 / e.sum(1)
    key = inv[ok] * len(LANGUAGES) + best[ok]
    n, c = np.bincount(key), np.bincount(key, weights=conf[ok])
    start, end = np.full(len(n), 1 << 31, np.int64), np.zeros(len(n), np.int64)
    where = np.array(places, np.int64).reshape(-1, 2)[ok]
    np.minimum.at(start, key, where[:, 0])
    np.maximum.at(end, key, where[:, 1])
    return [(int(u[k // len(LANGUAGES)] >> 32), int(u[k // len(LANGUAGES)] & 0xFFFFFFFF), int(k % len(LANGUAGES)), int(n[k]), float(c[k] / n[k]), int(start[k]), int(end[k])) for k in np.flatnonzero(n)]


def documents(staged: DataFrame) -> DataFrame:
    """(staged_id, lang, confidence, share, mixed): the language of most sentences of each record that has one, and whether it holds others."""
    s = segments(staged).groupBy("staged_id", "lang").agg(F.sum("sentences").alias("n"), (F.sum(F.col("sentences") * F.col("confidence")) / F.sum("sentences")).alias("confidence"))
    d = s.groupBy("staged_id").agg(F.max(F.struct("n", "lang", "confidence")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("langs"))
    return d.select("staged_id", "top.lang", "top.confidence", (F.col("top.n") / F.col("all")).alias("share"), (F.col("langs") > 1).alias("mixed"))


def found(staged: DataFrame) -> DataFrame:
    return segments(staged).where("stated is null or lang <> stated").select("staged_id", "turn_no", "lang").distinct()
