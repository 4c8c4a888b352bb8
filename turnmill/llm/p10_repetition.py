"""Problem 10: repetition inside a document, by weak supervision.

Six rules measure a document and vote "repeats", "doesn't" or abstain. The counts of the vote patterns over all documents
(at most 3^6 rows, whatever the number of documents) go to expectation-maximisation of a model in which a document repeats or
not and each rule votes with unknown rates; the posterior of the pattern is the document's probability of repeating. It replaces a
filter in which all rules must pass.

No rule's rates are given, the first one's neither, although it measures what p10_found defines: what a rule is worth is learnt from how it agrees with the
others. So documents of which one rule alone says that they repeat may be overruled (README: what that costs).
p10_found takes the documents whose posterior reaches CUT and checks the defined share exactly.

Results: a row a document. Null and empty texts and those under MIN_WORDS words have share 0 and all rules abstain. Rows with the same
doc_id are measured one by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.texts import mix, runs, word_spans
from turnmill.session import written

RUN = 5
MIN_WORDS = 20
SHARE = 0.3
CUT = 0.05

#: name of a measure, votes "repeats" from, votes "doesn't" up to (between: abstains)
RULES = (("run_share", 0.3, 0.2), ("sentence_share", 0.25, 0.05), ("line_share", 0.3, 0.0), ("top_share", 0.08, 0.03), ("longest_share", 0.15, 0.05), ("repeat_rate", 0.55, 0.35))
STATS = ", ".join(f"{n} double" for n, _, _ in RULES)


def covered(words: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a run of k words that has occurred before, starting at an earlier word of the text."""
    out = np.zeros(len(words) + 1, np.int64)
    h, owner = runs(words, ends, k)
    if len(h):
        length = np.diff(ends)
        start = np.arange(len(h)) + (np.cumsum(np.where(length >= k, k - 1, length)) - np.where(length >= k, k - 1, length))[owner]
        key = mix(h + mix(owner.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        again = order[1:][key[order][1:] == key[order][:-1]]
        np.add.at(out, start[again], 1)
        np.add.at(out, start[again] + k, -1)
    return np.cumsum(out[:-1]) > 0


def _repeated_pieces(words: np.ndarray, owner: np.ndarray, piece: np.ndarray, n: int, least: int) -> np.ndarray:
    """Words of each text in pieces (sentences, lines) of at least ``least`` words that the text has had before."""
    if not len(words):
        return np.zeros(n)
    first = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1]))))
    size = np.diff(np.concatenate((first, [len(words)])))
    at = np.arange(len(words)) - np.repeat(first, size)
    key = np.add.reduceat(mix(words + mix(at.astype(np.uint64) + np.uint64(11))), first)
    text = owner[first]
    ok = size >= least
    key, text, size = mix(key + mix(text.astype(np.uint64)))[ok], text[ok], size[ok]
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    return np.bincount(text[again], weights=size[again], minlength=n)


def measures(texts: list[str | None]) -> np.ndarray:
    """Number of words, then the measures of RULES, a row a text."""
    n = len(texts)
    w, _, _, ends, sentence = word_spans(texts, ".?!\n")
    _, _, _, _, line = word_spans(texts, "\n")
    size = np.diff(ends)
    owner = np.repeat(np.arange(n), size)
    total = np.maximum(size, 1)
    cover = covered(w, ends, RUN)
    run = np.bincount(owner, weights=cover, minlength=n) / total
    # the longest stretch of words that all lie in repeated runs
    edge = np.flatnonzero(np.concatenate(([True], (cover[1:] != cover[:-1]) | (owner[1:] != owner[:-1])))) if len(w) else np.empty(0, np.int64)
    longest = np.zeros(n)
    if len(edge):
        np.maximum.at(longest, owner[edge], np.diff(np.concatenate((edge, [len(w)]))) * cover[edge])
    # the most frequent pair of words, and the share of words seen before
    h, o = runs(w, ends, 2)
    top = np.zeros(n)
    if len(h):
        k2 = np.sort((o.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        first = np.flatnonzero(np.concatenate(([True], k2[1:] != k2[:-1])))
        np.maximum.at(top, (k2[first] >> np.uint64(40)).astype(np.int64), np.diff(np.concatenate((first, [len(k2)]))).astype(float))
    k1 = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (w >> np.uint64(24)))
    distinct = np.bincount((k1[np.concatenate(([True], k1[1:] != k1[:-1]))] >> np.uint64(40)).astype(np.int64), minlength=n) if len(k1) else np.zeros(n)
    return np.stack((size, run, _repeated_pieces(w, owner, sentence, n, 4) / total, _repeated_pieces(w, owner, line, n, 2) / total, np.where(top > 2, top / total, 0), longest / total, np.where(size > 0, 1 - distinct / total, 0)), 1)


def votes(m: np.ndarray) -> np.ndarray:
    """1 repeats, 0 doesn't, 2 abstains; a row a text."""
    v = np.full((len(m), len(RULES)), 2, np.int8)
    for i, (_, yes, no) in enumerate(RULES):
        v[m[:, i + 1] >= yes, i] = 1
        v[(m[:, i + 1] < yes) & (m[:, i + 1] <= no), i] = 0
    v[m[:, 0] < MIN_WORDS] = 2
    return v


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Posterior probability of repeating for each vote pattern, by EM over the patterns and how many documents have them, until the likelihood stands still."""
    r = patterns.shape[1]
    one = np.stack([(patterns == v) for v in range(3)], 2).astype(float)  # pattern, rule, vote
    # rates[class, rule, vote]: where EM starts, and the prior it keeps
    rates = np.array([[[0.7, 0.05, 0.25]] * r, [[0.2, 0.5, 0.3]] * r])
    prior = rates * 2
    share = 0.1
    post, before = np.zeros(len(counts)), -np.inf
    for _ in range(rounds):
        like = np.einsum("prv,crv->cp", one, np.log(rates)) + np.log([[1 - share], [share]])
        both = np.logaddexp(*like)
        post = np.exp(like[1] - both)
        now = float((counts * both).sum() / max(1, counts.sum()))
        if abs(now - before) < tolerance:
            break
        before = now
        w = np.stack((counts * (1 - post), counts * post))
        rates = np.einsum("cp,prv->crv", w, one) + prior
        rates /= rates.sum(2, keepdims=True)
        share = min(0.9, max(1e-4, (w[1].sum() + 1) / (counts.sum() + 10)))
    return post


def repetition(documents: DataFrame) -> DataFrame:
    """(doc_id, words, the measures, pattern, posterior), a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                p = b.slice(lo, 1000)
                m = measures(p["text"].to_pylist())
                code = votes(m).astype(np.int64) @ (3 ** np.arange(len(RULES)))
                yield pa.RecordBatch.from_arrays([p["doc_id"], pa.array(m[:, 0].astype(np.int64)), *(pa.array(m[:, i + 1]) for i in range(len(RULES))), pa.array(code.astype(np.int32))], ["doc_id", "words", *(x for x, _, _ in RULES), "pattern"])

    measured = written(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, words long, {STATS}, pattern int"), "measures")
    seen = measured.groupBy("pattern").count().collect()  # at most 3 ** len(RULES) rows
    code = np.array([x["pattern"] for x in seen], dtype=np.int64)
    post = fit((code[:, None] // 3 ** np.arange(len(RULES))) % 3, np.array([x["count"] for x in seen], dtype=float)) if len(code) else np.empty(0)
    model = measured.sparkSession.createDataFrame([(int(c), float(x)) for c, x in zip(code, post, strict=True)], "pattern int, posterior double")
    return measured.join(F.broadcast(model), "pattern")


def found(documents: DataFrame) -> DataFrame:
    r = repetition(documents).where((F.col("posterior") >= CUT) & (F.col("run_share") >= SHARE) & (F.col("words") >= MIN_WORDS))
    return r.where("doc_id is not null").select("doc_id").distinct()
