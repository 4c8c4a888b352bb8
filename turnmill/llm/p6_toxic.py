"""Problem 6: abusive, hateful and sexual wording, by a linear-chain conditional random field.

Words are read through their disguises (look-alikes, invisible characters, digits for letters, drawn-out and spaced letters). Each word of a sentence
is tagged ``O`` or with a category; forward-backward marginals give each word a probability for each category. A sentence scores its
highest marginal, a record its highest sentence; the offending words come with their offsets.

The field is trained on labelled tokens. Labels are given to records, not to tokens, and raters err, so tokens are labelled from a bounded
sample of labelled records (at most LABELS of them, by the hash of the label id): the words of a sentence are tagged with a
category if most of its runs of three words occur mostly in records labelled toxic (more than by chance), or if it has a flag term
and its record is labelled with the term's category; all other sentences of records labelled clean are O. Sentences of toxic records that are neither are left out.

Results: ``scores``: (staged_id, abuse, hate, sexual, spans), a row a record that parses; ``found``: categories with a score of THRESHOLD or more.
Null ids give no rows; null and unparsable turns neither; repeated ids count once in ``found``; empty tables give no rows, and
without toxic labels nothing is found.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.p5_pii import _GONE, _PLAIN
from turnmill.llm.texts import mix, turns_of

CATEGORIES = ("abuse", "hate", "sexual")
STATES = 1 + len(CATEGORIES)
LABELS = 12_000
NEGATIVES = 14_000
#: Words a training example: longer sentences are cut into several.
PIECE = 200
BITS = 16
THRESHOLD = 0.5
ROUNDS = 20
#: A run of three words is associated if so many records have it and such a share of them is toxic.
LEAST, SHARE = 3, 0.7

_TABLE = {k: v for k, v in _PLAIN.items()} | {ord(c): None for c in _GONE} | {ord("*"): " ", ord("_"): " "}
TOKEN = re.compile(r"[^\W_]+(?:[@$!|'’-][^\W_]+)*|[.?!\n]")
_LEET = str.maketrans("4@3105$7!|", "aaeiosstii")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_DIGIT_OR_MARK = re.compile(r"[\d@$!|]")
_LETTER = re.compile(r"[^\W\d_]")
_ENDING = re.compile(r"^[\W_]+|[\W_]+$")


def plain(token: str) -> str:
    """A lower-case token without its disguises and the marks at its ends; the end of a sentence stays."""
    if token == ".":
        return token
    token = _ENDING.sub("", token)
    if not token.isalpha():
        if _LETTER.search(token):
            if _DIGIT_OR_MARK.search(token):
                token = token.translate(_LEET)
            token = re.sub(r"[@$!|'’-]", "", token)
        elif token.isdigit():
            return "0"
    return _DRAWN.sub(r"\1", token)


class Tokens(dict):
    """token -> plain token."""

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
        p = self[token] = plain(token)
        return p


_tokens = Tokens()


#: ASCII marks that part words; those of TOKEN inside words stay, and fall off a word's ends in ``plain``.
_PARTING = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum() and c not in "@$!|'-. "})
_BANG = re.compile(r"!(?![^\W_])|(?<![^\W_])!")
_UNUSUAL = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_TABLE)) + "]")


def _spaced(tokens: list[str]) -> bool:
    """Whether three tokens in a row are single characters (ends of sentences among them: a first look)."""
    long = max(map(len, tokens), default=0) > 255
    return b"\1\1\1" in bytes((min(len(t), 2) for t in tokens) if long else map(len, tokens))


def sentences(text: str) -> list[list[str]]:
    """Plain words of the sentences of a text."""
    low = (text.translate(_TABLE) if _UNUSUAL.search(text) else text).lower()
    if "!" in low:
        low = _BANG.sub(" . ", low)
    tokens = low.replace(".", " . ").replace("?", " . ").replace("\n", " . ").translate(_PARTING).split()
    words = list(map(_tokens.__getitem__, tokens))
    if "" in words:
        tokens = [t for t, w in zip(tokens, words, strict=True) if w]
        words = [w for w in words if w]
    if _spaced(tokens):
        tokens, words = _despaced(tokens, words)
    out, a = [], 0
    for i in [i for i, t in enumerate(tokens) if t == "."]:
        if i > a:
            out.append(words[a:i])
        a = i + 1
    if a < len(words):
        out.append(words[a:])
    return out


def located(text: str) -> list[list[tuple[int, int]]]:
    """Where the words of ``sentences`` stand in the text, in characters. Slower, so it is asked only for what was found."""
    chars = [(c, i) for i, x in enumerate(text) for c in (_TABLE.get(ord(x), x) or "").lower()]
    low = "".join(c for c, _ in chars)
    ends = {m.start() for m in _BANG.finditer(low)} if "!" in low else set()
    spots: list[tuple[int, int]] = []
    a = None
    for i, c in enumerate(low + " "):
        part = i < len(low) and (c in ".?\n" or i in ends)
        if part or c.isspace() or c.translate(_PARTING) == " ":
            if a is not None:
                spots.append((a, i))
                a = None
            if part:
                spots.append((i, i + 1))
        elif a is None:
            a = i
    words = [("." if low[x:y] in ("?", "\n") or x in ends else low[x:y], x, y) for x, y in spots]
    words = [(t, x, y) for t, x, y in words if plain(t)]
    out: list[list[tuple[int, int]]] = [[]]
    i = 0
    while i < len(words):
        j = i
        while j < len(words) and len(words[j][0]) == 1 and words[j][0] != ".":
            j += 1
        if j - i >= 3:
            out[-1].append((words[i][1], words[j - 1][2]))
            i = j
            continue
        if words[i][0] == ".":
            out.append([])
        else:
            out[-1].append(words[i][1:])
        i += 1
    return [[(chars[x][1], chars[y - 1][1] + 1) for x, y in s] for s in out if s]


def _despaced(tokens: list[str], words: list[str]) -> tuple[list[str], list[str]]:
    """Three single characters or more in a row are one word."""
    t2, w2, i = [], [], 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and len(tokens[j]) == 1 and tokens[j] != ".":
            j += 1
        if j - i >= 3:
            t2.append("".join(tokens[i:j]))
            w2.append(plain(t2[-1]))
        else:
            j = max(j, i + 1)
            t2 += tokens[i:j]
            w2 += words[i:j]
        i = j
    return t2, w2


class Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        # signed, so that numpy takes it as it is
        h = self[w] = (xxhash.xxh3_64_intdigest(w) ^ (1 << 63)) - (1 << 63)
        return h


_hashes = Hashes()
SEEDS = np.array([3, 5, 7, 11, 13, 17, 19], np.uint64)


def features(sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word (a row each), and the offsets of the sentences."""
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sents])))
    n = int(ends[-1])
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(sents)), np.int64, n).view(np.uint64)
    edge = np.uint64(0xABCDEF)
    first, last = ends[:-1], ends[1:] - 1
    prev = np.concatenate(([edge], h[:-1])) if n else h
    nxt = np.concatenate((h[1:], [edge])) if n else h
    prev[first], nxt[last] = edge, edge
    prev2 = np.concatenate(([edge], prev[:-1])) if n else h
    next2 = np.concatenate((nxt[1:], [edge])) if n else h
    prev2[first], next2[last] = edge, edge
    three = np.uint64(3)
    cols = (h, prev, nxt, prev * three + h, h * three + nxt, (prev2 * three + prev) * three + h, (h * three + nxt) * three + next2)
    return np.stack([(mix(c + s) >> np.uint64(64 - BITS)).astype(np.int64) for c, s in zip(cols, SEEDS, strict=True)], 1), ends


class Field:
    """Weights of the field: emissions (feature, state) and transitions."""

    def __init__(self, emit: np.ndarray, trans: np.ndarray):
        self.emit, self.trans = emit.astype(np.float32), trans

    def marginals(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the categories for each word, and the offsets of the sentences."""
        x, ends = features(sents)
        score = np.zeros((len(x), STATES), np.float32)
        for k in range(x.shape[1]):
            score += self.emit[x[:, k]]
        score += self.emit[-1]
        out = np.zeros((len(x), STATES - 1), np.float32)
        if not len(x):
            return out, ends
        length = np.diff(ends)
        for group in _groups(length[np.argsort(length, kind="stable")], np.argsort(length, kind="stable")):
            at, mask = _padded(ends, group)
            out[at[mask]] = _marginals(score[at], mask, self.trans)[mask][:, 1:]
        return out, ends


def _groups(length: np.ndarray, order: np.ndarray, most: int = 256, places: int = 40_000) -> Iterator[np.ndarray]:
    """Sentences of about the same length together, at most ``most`` of them and so many that they fill ``places`` when padded (a longer sentence stands alone)."""
    a = 0
    while a < len(order):
        z = min(len(order), a + most)
        while z > a + 1 and (z - a) * length[z - 1] > places:
            z = a + max(1, (z - a) // 2)
        yield order[a:z]
        a = z


def _padded(ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(ends)[which]
    steps = np.arange(n.max())
    return np.minimum(ends[:-1][which][:, None] + steps, ends[-1] - 1), steps < n[:, None]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _forward_backward(s: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (sentence, step, state), expected transitions and log partition of padded scores."""
    b, t, k = s.shape
    alpha, beta = np.zeros((b, t, k)), np.zeros((b, t, k))
    alpha[:, 0] = s[:, 0]
    for i in range(1, t):
        a = _lse(alpha[:, i - 1, :, None] + trans, 1) + s[:, i]
        alpha[:, i] = np.where(mask[:, i, None], a, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        z = _lse(trans + (s[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where(mask[:, i + 1, None], z, 0)
    log_z = _lse(alpha[:, -1], 1)
    p = np.exp(alpha + beta - log_z[:, None, None])
    pair = np.zeros((k, k))
    for i in range(1, t):
        m = mask[:, i]
        if m.any():
            pair += np.exp(alpha[m, i - 1, :, None] + trans + (s[m, i] + beta[m, i])[:, None, :] - log_z[m, None, None]).sum(0)
    return p * mask[:, :, None], pair, log_z


def _marginals(s: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginals (sentence, step, state) of padded scores: forward and backward passes over probabilities that are scaled at each step, without logarithms."""
    e = np.ascontiguousarray(np.exp(s.astype(np.float64) - s.max(2, keepdims=True)).transpose(1, 0, 2))
    a = np.exp(trans - trans.max())
    inside = np.ascontiguousarray(mask.T)[:, :, None]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[0] = e[0] / e[0].sum(1, keepdims=True)
    for i in range(1, len(e)):
        x = (alpha[i - 1] @ a) * e[i]
        x /= x.sum(1, keepdims=True)
        alpha[i] = np.where(inside[i], x, alpha[i - 1])
    for i in range(len(e) - 2, -1, -1):
        x = (e[i + 1] * beta[i + 1]) @ a.T
        x /= x.sum(1, keepdims=True)
        beta[i] = np.where(inside[i + 1], x, 1.0)
    p = alpha * beta
    return (p / p.sum(2, keepdims=True)).transpose(1, 0, 2)


def train(sents: list[list[str]], tags: list[np.ndarray], rounds: int = ROUNDS, l2: float = 2e-4) -> Field:
    """Adagrad on mini-batches of the penalised likelihood."""
    x, ends = features(sents)
    y = np.concatenate(tags)
    size = 1 << BITS
    emit, trans = np.zeros((size + 1, STATES)), np.zeros((STATES, STATES))
    ge, gt = np.full_like(emit, 1e-2), np.full_like(trans, 1.0)
    rng = np.random.default_rng(3)
    length = np.diff(ends)
    order = np.argsort(length, kind="stable")
    groups = np.array_split(order, max(1, len(order) // 400))
    for _ in range(rounds):
        for g in rng.permutation(len(groups)):
            at, mask = _padded(ends, groups[g])
            f = x[at[mask]]
            s = np.zeros((*mask.shape, STATES))
            s[mask] = emit[f].sum(1) + emit[-1]
            p, pair, _ = _forward_backward(s, mask, trans)
            d = -p[mask]
            d[np.arange(len(d)), y[at[mask]]] += 1
            n = len(groups[g])
            grad_e = np.zeros_like(emit)
            u, inv = np.unique(f, return_inverse=True)
            inv = inv.reshape(f.shape)
            for k in range(STATES):
                grad_e[u, k] = np.bincount(inv.ravel(), weights=np.repeat(d[:, k], f.shape[1]), minlength=len(u))
            grad_e[-1] = d.sum(0)
            rows = np.append(u, size)
            grad = grad_e[rows] / n - l2 * emit[rows]
            ge[rows] += grad**2
            emit[rows] += 0.3 * grad / np.sqrt(ge[rows])
            seen = np.zeros_like(trans)
            yy = np.where(mask, y[at], 0)
            both = mask[:, 1:]
            np.add.at(seen, (yy[:, :-1][both], yy[:, 1:][both]), 1)
            grad_t = (seen - pair) / n - 1e-3 * trans
            gt += grad_t**2
            trans += 0.3 * grad_t / np.sqrt(gt)
    return Field(emit, trans)


def _tail(n: int, of: int, base: float) -> float:
    """Probability of n or more of ``of`` at a rate of base."""
    if base <= 0 or base >= 1:
        return float(base >= 1)
    total = 0.0
    for k in range(n, of + 1):
        term = math.exp(math.lgamma(of + 1) - math.lgamma(k + 1) - math.lgamma(of - k + 1) + k * math.log(base) + (of - k) * math.log1p(-base))
        total += term
        if k > of * base and term < 1e-12 * total:
            break
    return total


def labelled(records: list[tuple[str, int, str | None]], terms: list[tuple[str, str]]) -> tuple[list[list[str]], list[np.ndarray]]:
    """Tagged sentences from (turns, toxic, category) of labelled records and (term, category)."""
    split = [[s for _, c in turns_of(t) or [] for s in sentences(c)] for t, _, _ in records]
    runs = lambda s: {" ".join(s[i : i + 3]) for i in range(len(s) - 2)}
    toxic: Counter = Counter()
    counted: set[str] = set()
    clean: Counter = Counter()
    for sents, (_, label, _) in zip(split, records, strict=True):
        keys = set().union(*(runs(s) for s in sents)) if sents else set()
        if label == 1:
            # a copy of a record that was counted tells nothing new
            whole = {" ".join(s) for s in sents}
            if 2 * len(whole & counted) <= len(whole):
                toxic.update(keys)
            counted |= whole
        elif label == 0:
            clean.update(keys)
    # by chance, under one run in as many as there are toxic records may look associated
    base = sum(label == 1 for _, label, _ in records) / max(1, sum(label in (0, 1) for _, label, _ in records))
    rare = 1 / max(1, sum(label == 1 for _, label, _ in records))
    share = {k: n / (n + clean[k]) for k, n in toxic.items() if n >= LEAST and n >= SHARE * (n + clean[k]) and _tail(n, n + clean[k], base) <= rare}
    strong = lambda s: (k := runs(s)) and len(k) >= 2 and sum(share.get(x, 0) >= SHARE for x in k) >= max(2, 0.45 * len(k))
    # a run's category: that of the records of which it is the only toxic sentence; others count little
    kinds: dict[str, Counter] = defaultdict(Counter)
    for sents, (_, label, category) in zip(split, records, strict=True):
        if label == 1 and category in CATEGORIES:
            hits = [s for s in sents if strong(s)]
            for s in hits:
                for x in runs(s):
                    kinds[x][category] += 1 if len(hits) == 1 else 0.05
    words = [(w, CATEGORIES.index(c)) for t, c in terms if c in CATEGORIES and (w := [plain(x) for x in TOKEN.findall(t.lower())])]

    def category_of(s: list[str], label: int, category: str | None) -> int:
        """0: none, 1..: a category, -1: unclear."""
        k = runs(s)
        if strong(s):
            votes: Counter = Counter()
            for x in k:
                votes.update(kinds[x])
            if votes:
                return 1 + CATEGORIES.index(votes.most_common(1)[0][0])
        if label == 1:
            for w, c in words:
                if category == CATEGORIES[c] and any(s[i : i + len(w)] == w for i in range(len(s) - len(w) + 1)):
                    weak = sum(clean[x] for x in k) > 3 * len(k)
                    return -1 if weak else 1 + c
            return -1
        return 0 if label == 0 else -1

    tagged, plainly, wary, rest = [], [], [], []
    risky: Counter = Counter()
    for sents, (_, label, category) in zip(split, records, strict=True):
        for s in sents:
            c = category_of(s, label, category)
            if c > 0:
                tagged.append((s, c))
                risky.update(set(s))
            elif c == 0:
                plainly.append(s)
    # of the clean sentences, those that share rare words with toxic ones first
    common = Counter(w for s in plainly for w in set(s))
    near = {w for w in risky if common[w] < 0.02 * max(1, len(plainly))} | {w for ws, _ in words for w in ws}
    seen = set()
    for s in plainly:
        if (k := " ".join(s)) not in seen:
            seen.add(k)
            (rest if near.isdisjoint(s) else wary).append(s)
    rng = np.random.default_rng(5)
    pick = lambda xs, n: [xs[i] for i in rng.permutation(len(xs))[:n]]
    negatives = pick(wary, NEGATIVES // 2)
    negatives += pick(rest, NEGATIVES - len(negatives))
    # tagged sentences are few; they are repeated to about an eighth of the rest
    again = max(1, min(10, len(negatives) // (8 * max(1, len(tagged)))))
    parts = lambda s: [s[i : i + PIECE] for i in range(0, len(s), PIECE)]
    data = [(p, np.full(len(p), c)) for s, c in tagged for p in parts(s)] * again + [(p, np.zeros(len(p), np.int64)) for s in negatives for p in parts(s)]
    return [s for s, _ in data], [t for _, t in data]


def fitted(staged: DataFrame, labels: DataFrame, flag_terms: DataFrame) -> Field | None:
    """The field, from at most LABELS labelled records."""
    one = labels.where("staged_id is not null and toxic is not null").groupBy("staged_id").agg(
        # raters disagree: the majority counts, a tie is unclear
        F.avg("toxic").alias("toxic"), F.max("category").alias("category"), F.min(F.xxhash64("label_id")).alias("h"))
    one = one.where("toxic <> 0.5").orderBy("h").limit(LABELS)
    rows = staged.select(F.col("id").alias("staged_id"), "scrubbed_turns").join(F.broadcast(one), "staged_id").select("scrubbed_turns", F.col("toxic").cast("double"), "category").collect()
    records = sorted(((r["scrubbed_turns"] or "", int(r["toxic"] > 0.5), r["category"]) for r in rows), key=lambda r: (r[0], r[1], r[2] or ""))
    terms = [(r["term"], r["category"]) for r in flag_terms.where("term is not null").select("term", "category").distinct().limit(10_001).collect()]
    if len(terms) > 10_000:
        raise ValueError("more flag terms than are looked for")
    sents, tags = labelled(records, sorted(terms, key=str))
    if not any(t[0] > 0 for t in tags):
        return None
    return train(sents, tags)


def scores(staged: DataFrame, labels: DataFrame, flag_terms: DataFrame) -> DataFrame:
    """(staged_id, abuse, hate, sexual, spans): spans are where the offending words stand: turn, first character and the one behind the last, category."""
    schema = "staged_id string, abuse double, hate double, sexual double, spans array<struct<turn_no: long, start: int, end: int, category: string>>"
    field = fitted(staged, labels, flag_terms)
    if field is None:
        return staged.where("id is not null").select(F.col("id").alias("staged_id"), *(F.lit(0.0).alias(c) for c in CATEGORIES), F.expr(f"cast(array() as {schema.split('spans ')[1]})").alias("spans"))
    shared = staged.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("turn_no", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("category", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 300):
                p = b.slice(lo, 300)
                ids, sents, where, contents = [], [], [], []
                for i, t in zip(p["id"].to_pylist(), p["scrubbed_turns"].to_pylist(), strict=True):
                    if (turns := turns_of(t)) is None:
                        continue
                    for j, (_, c) in enumerate(turns):
                        new = sentences(c)
                        sents += new
                        where += [(len(ids), j, k) for k in range(len(new))]
                    ids.append(i)
                    contents.append([c for _, c in turns])
                best = np.zeros((len(ids), len(CATEGORIES)))
                spans: list[list[dict]] = [[] for _ in ids]
                m, ends = shared.value.marginals(sents)
                if len(m):
                    top = np.maximum.reduceat(m, ends[:-1])
                    np.maximum.at(best, np.array([w[0] for w in where]), top)
                    for s in np.flatnonzero(top.max(1) >= THRESHOLD):
                        rec, turn, k = where[s]
                        c = int(top[s].argmax())
                        hit = np.flatnonzero(m[ends[s] : ends[s + 1], c] >= THRESHOLD)
                        words = located(contents[rec][turn])
                        # where a letter's lower case would part words otherwise, the whole turn is the place
                        fits = k < len(words) and len(words[k]) == ends[s + 1] - ends[s]
                        a, z = (words[k][hit[0]][0], words[k][hit[-1]][1]) if fits else (0, len(contents[rec][turn]))
                        spans[rec].append({"turn_no": turn, "start": a, "end": z, "category": CATEGORIES[c]})
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *(pa.array(best[:, c]) for c in range(len(CATEGORIES))), pa.array(spans, kind)], ["staged_id", *CATEGORIES, "spans"])

    return staged.where("id is not null").select("id", "scrubbed_turns").mapInArrow(run, schema)


def found(staged: DataFrame, labels: DataFrame, flag_terms: DataFrame) -> DataFrame:
    hit = F.explode(F.array_compact(F.array(*(F.when(F.col(c) >= THRESHOLD, c) for c in CATEGORIES))))
    return scores(staged, labels, flag_terms).select("staged_id", hit.alias("category")).distinct()


def rates(staged: DataFrame, exchanges: DataFrame, sessions: DataFrame, labels: DataFrame, flag_terms: DataFrame) -> DataFrame:
    """(source, records, abuse_rate, hate_rate, sexual_rate); records whose exchange or session is unknown have a null source."""
    s = scores(staged, labels, flag_terms).select("staged_id", *((F.col(c) >= THRESHOLD).cast("int").alias(c) for c in CATEGORIES))
    link = staged.select(F.col("id").alias("staged_id"), "exchange_id")
    ex = exchanges.where("id is not null").groupBy(F.col("id").alias("exchange_id")).agg(F.max("session_id").alias("session_id"))
    ses = sessions.select("session_id", "source")
    j = link.join(s, "staged_id").join(ex, "exchange_id", "left").join(ses, "session_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("records"), *(F.avg(c).alias(f"{c}_rate") for c in CATEGORIES))
