"""Texts, words and shingles shared by the operators of this subpackage.

Everything here works on whole Arrow batches: words are cut and hashed as polynomials
of their code points; all of it is numpy on flat arrays (one entry per code point, word or shingle of the batch).
"""

from __future__ import annotations

import json
import re

import numpy as np

WORD = re.compile(r"[^\W_]+")

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a fixed bijection of 64-bit integers."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


class _Chars:
    """Per code point: whether it is a letter or digit, and a 64-bit value of its lower case. Code points from LIMIT on are looked up one by one."""

    LIMIT = 0x3100
    BASE = 0xD6E8FEB86659FD93

    def __init__(self) -> None:
        codes = range(self.LIMIT)
        self.alnum = np.array([chr(c).isalnum() for c in codes])
        self.value = mix(np.array([ord(chr(c).lower()[0]) for c in codes], dtype=np.uint64) + np.uint64(1))
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        """Powers of BASE and of its inverse modulo 2**64, up to n."""
        if len(self.power) <= n:
            m = max(n + 1, 1 << 20)
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))


_chars: _Chars | None = None


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _words(text: str, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end code point of every word, and the number of marks before it."""
    global _chars
    c = _chars = _chars or _Chars()
    codes = codes_of(text)
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.minimum(codes, c.LIMIT - 1)
    alnum, value = c.alnum[low], c.value[low]
    if len(high := np.flatnonzero(codes >= c.LIMIT)):
        u, at = np.unique(codes[high], return_inverse=True)
        alnum[high] = np.array([chr(x).isalnum() for x in u])[at]
        value[high] = mix(np.array([ord(chr(x).lower()[0]) for x in u], np.uint64) + np.uint64(1))[at]
    c.grow(len(codes))
    edge = np.diff(np.concatenate(([0], alnum.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * c.power[: len(codes)])))
    before = np.cumsum(np.isin(codes, marks))[start] if marks is not None else start
    return mix((total[end] - total[start]) * c.inverse[start]), start, end, before


def word_spans(texts: list[str | None], marks: str = "", at_once: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (code points within its text) of all words of all texts, the offsets of the texts in them
    (len(texts) + 1), and the running number of the piece between two ``marks`` that a word lies in (texts lie in pieces of their own if "\\n" is a mark).

    Null and empty texts have no words. Texts are worked on whole, about ``at_once`` code points at a time.
    """
    hashes, starts, stops, pieces, counts = [], [], [], [], np.zeros(len(texts), np.int64)
    codes = np.array([ord(x) for x in marks], np.uint32) if marks else None
    piece = 0
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= at_once):
            size += len(texts[j] or "") + 1
            j += 1
        part = [t or "" for t in texts[i:j]]
        h, s, e, before = _words("\n".join(part), codes)
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
        owner = np.searchsorted(begin, s, side="right") - 1
        counts[i:j] = np.bincount(owner, minlength=j - i)
        hashes.append(h)
        starts.append(s - begin[owner])
        stops.append(e - begin[owner])
        pieces.append(before + piece)
        piece += size
        i = j
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(stops), np.concatenate(([0], np.cumsum(counts))), np.concatenate(pieces)


def word_arrays(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the offsets of the texts (len(texts) + 1)."""
    h, _, _, ends, _ = word_spans(texts)
    return h, ends


def runs(words: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the run of k words that starts at each word, and the text of the run; runs across texts are left out."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = words[: n - k + 1].copy()
    for i in range(1, k):
        h = mix(h + np.uint64(0x9E3779B97F4A7C15)) + words[i : n - k + 1 + i]
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    inside = owner[: n - k + 1] == owner[k - 1 :]
    return mix(h)[inside], owner[: n - k + 1][inside]


def messages_of(request: str | None) -> list[tuple[str | None, str]] | None:
    """(role, content) of each message of a request, position kept; a prompt is one user message. None: it doesn't parse."""
    try:
        r = json.loads(request) if request else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(r, dict):
        return None
    if isinstance(m := r.get("messages"), list):
        return [((x.get("role"), x["content"]) if isinstance(x, dict) and isinstance(x.get("content"), str) else (x.get("role") if isinstance(x, dict) else None, "")) for x in m]
    if isinstance(p := r.get("prompt"), str):
        return [("user", p)]
    return None


def turns_of(turns: str | None) -> list[tuple[str | None, str]] | None:
    """(role, content) of each turn of a staged record; None: it doesn't parse."""
    try:
        r = json.loads(turns) if turns else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(r, list):
        return None
    return [((x.get("role"), x["content"]) if isinstance(x, dict) and isinstance(x.get("content"), str) else (x.get("role") if isinstance(x, dict) else None, "")) for x in r]


def request_text(request: str | None) -> str | None:
    """Contents of the user and assistant messages of a request, joined by a space; None if it doesn't parse."""
    m = messages_of(request)
    return None if m is None else " ".join(c for role, c in m if role in ("user", "assistant"))


def turns_text(turns: str | None) -> str | None:
    """Contents of the turns, joined by a space; None if they don't parse."""
    m = turns_of(turns)
    return None if m is None else " ".join(c for _, c in m)


def answer_of(response: str | None) -> str | None:
    """The answer in a response of any of the three shapes: None if the response doesn't parse, "" if it holds none."""
    try:
        r = json.loads(response) if response else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(r, dict):
        return None
    if "choices" in r:
        c = r["choices"]
        m = c[0].get("message") if isinstance(c, list) and c and isinstance(c[0], dict) else None
    else:
        m = r.get("message")
    if isinstance(m, dict):
        t = m.get("content")
    else:
        t = r.get("response")
    return t if isinstance(t, str) else ""
