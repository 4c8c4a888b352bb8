"""The scrub chain, the gate and the content filter, as Arrow functions over whole batches.

Order matters: normalise, URLs, secrets, cards, IPv6, then the structured patterns. The chain runs in one hop to Python;
functions/native.py has twins of single passes that stay in the JVM.
"""

from __future__ import annotations

import base64
import math
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from turnmill.functions import patterns as P

#: Vocabulary file from which the dictionary is made by default.
VOCABULARY = os.environ.get("TURNMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def dictionary(path: str | None = None) -> frozenset[str]:
    """Lower-case words of four letters or more: of a word list (a word a line), or of a tokenizer's vocabulary file (whole words with a space before them)."""
    path = path or VOCABULARY
    if not path or path == "none":
        return frozenset()  # asked for: no dictionary
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}: set TURNMILL_VOCABULARY on all executors, or to none to scrub without a dictionary")
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            words = (base64.b64decode(line.split()[0]) for line in f if line.strip())
            return frozenset(w[1:].decode() for w in words if re.fullmatch(rb" [a-z]{4,}", w))
    with open(path, encoding="utf-8") as f:
        return frozenset(w for line in f if re.fullmatch("[a-z]{4,}", w := line.strip()))


def normalise(text: str) -> str:
    """NFKC, without invisible characters."""
    return text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) if n else 0.0


def looks_benign(token: str, words: frozenset[str]) -> bool:
    """A URL or host path as a whole; or made of dictionary words: two at least, half of the length at least, and no long run beside them."""
    if _URLISH.fullmatch(token):
        return True
    parts = [s for p in re.split(r"[^A-Za-z]+", token) for s in _SEGMENT.findall(p)]
    known = [len(s) for s in parts if s.lower() in words]
    return len(known) >= 2 and 2 * sum(known) >= len(token) and all(len(s) <= P.LONGEST_NONWORD for s in parts if s.lower() not in words)


_INVISIBLE = re.compile(P.INVISIBLE_CLASS + "+")
_VENDOR, _BLOCK, _PATHS = ([re.compile(p) for p in ps] for ps in (P.VENDOR, P.BLOCK, P.PATHS))
_BASE64, _DOTTED, _GENERIC, _URLISH, _SEGMENT, _URL, _CARD, _IPV6 = (re.compile(p) for p in (P.BASE64, P.DOTTED, P.GENERIC, P.URLISH, P.SEGMENT, P.URL, P.CARD, P.IPV6))
#: Street names of any number of words: only Java's engine needs a bound.
_ADDRESS = P.ADDRESS.replace("{0,12}", "*")
_STRUCTURED = [(re.compile(p), tag) for p, tag in ((P.EMAIL, "[EMAIL]"), (P.SSN, "[SSN]"), (P.PHONE, "[PHONE]"), (P.PHONE_INTL, "[PHONE]"), (P.IPV4, "[IP]"), (_ADDRESS, "[ADDRESS]"), (P.STATE_ZIP, "[LOCATION]"))]


def _random(token: str, kind: str, words: frozenset[str]) -> bool:
    """Whether a token is taken for a secret by its entropy; kind: base64, dotted or generic."""
    head = token[: P.ENTROPY_SAMPLE]
    if kind == "base64":
        shaped = any(c.isdigit() or c in "+/=" for c in head)
    elif kind == "dotted":
        shaped = "." in head and ("+" in head or "/" in head)
    else:
        shaped = any(c.isdigit() for c in head)
    return shaped and entropy(head) > P.ENTROPY_BITS and not looks_benign(head, words)


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def reduce_urls(text: str) -> str:
    def host(m: re.Match) -> str:
        h = m[1].lower()
        return "[URL:suspicious]" if "." in h and h.rsplit(".", 1)[1] in P.SPAM_TLDS else f"[URL:{h}]"

    return _URL.sub(host, text) if "://" in text else text


# What a text must contain for a pattern to match at all, in lower case: most passes end with this look.
_VENDOR_NEED = ("sk-", "sk-ant-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "akia", "hf_", "npm_", "pypi-", "aiza", "ya29.", "ac", "sk", "sk_live_", "pk_live_", "rk_live_", "sg.", "dop_v1_", "eyj")
_BLOCK_NEED = (("private key",), ("private key",), ("private key",), ("private key",), ("://",), ("authorization:",), ("accountkey=",), ("sharedaccesskey=",), ("token", "key", "secret", "password", "passwd"), ("private",), ("signature=",), ("sig=",))
_PATH_NEED = ("/users/", "/home/", "c:\\users\\", "/root")
_LONG = re.compile(r"[A-Za-z0-9+/._=-]{24}")
_LOOKS = {p: re.compile(q) for p, q in ((P.EMAIL, "@"), (P.SSN, r"\d-\d\d-\d"), (P.PHONE, r"\d\d\d\)?[-.\s]?\d\d\d[-.\s]?\d\d\d\d"), (P.PHONE_INTL, r"\+\d"), (P.IPV4, r"\d\.\d{1,3}\.\d"), (_ADDRESS, r"\d\s+[A-Za-z]"), (P.STATE_ZIP, r"[A-Z]\s+\d{5}"))}
_CARD_LOOK, _IPV6_LOOK = re.compile(r"\d(?:[ -]?\d){12}"), re.compile(r":[0-9A-Fa-f]{0,4}:")


def _blocks(low: str) -> Iterator[re.Pattern]:
    for p, need in zip(_BLOCK, _BLOCK_NEED, strict=True):
        if any(x in low for x in need):
            yield p


def scrub_secrets(text: str, words: frozenset[str] | None = None) -> str:
    words = dictionary() if words is None else words
    low = text.lower()
    for p, need in zip(_VENDOR, _VENDOR_NEED, strict=True):
        if need in low:
            text = p.sub("[SECRET]", text)
    for p in _blocks(low):
        text = p.sub("[SECRET]", text)
    for p, need in zip(_PATHS, _PATH_NEED, strict=True):
        if need in low:
            text = p.sub("[PATH]", text)
    for p, kind in ((_BASE64, "base64"), (_DOTTED, "dotted"), (_GENERIC, "generic")) if _LONG.search(text) else ():
        text = p.sub(lambda m, kind=kind: "[SECRET]" if _random(m[0], kind, words) else m[0], text)
    return text


def redact_pii(text: str) -> str:
    if _CARD_LOOK.search(text):
        text = _CARD.sub(lambda m: "[CREDIT_CARD]" if _luhn(re.sub(r"\D", "", m[0])) else m[0], text)
    if _IPV6_LOOK.search(text):
        text = _IPV6.sub(lambda m: "[IP]" if any(c.isdigit() for c in m[0]) else m[0], text)
    for p, tag in _STRUCTURED:
        if _LOOKS[p.pattern].search(text):
            text = p.sub(tag, text)
    return text


def scrub(text: str | None, words: frozenset[str] | None = None) -> str | None:
    """The whole chain; null stays null."""
    return None if text is None else redact_pii(scrub_secrets(reduce_urls(normalise(text)), words))


_NEEDS = {p: (n,) for p, n in zip(P.VENDOR, _VENDOR_NEED, strict=True)} | dict(zip(P.BLOCK, _BLOCK_NEED, strict=True)) | {p: (n,) for p, n in zip(P.HOME_DIRS, _PATH_NEED, strict=True)}


def _needed(p: re.Pattern, text: str, low: str) -> bool:
    if p.pattern in _NEEDS:
        return any(x in low for x in _NEEDS[p.pattern])
    return p.pattern not in _LOOKS or _LOOKS[p.pattern].search(text) is not None


_GATE = [(kind, [re.compile(p) for p in ps]) for kind, ps in P.GATE]
_KNOWN = re.compile(r"\[(?:EMAIL|PHONE|LOCATION|DATE|ADDRESS|GROUP|SSN|IP|SECRET|PATH|CREDIT_CARD|IBAN|MEDICAL_ID|DRIVER_LICENSE|REDACTED|URL)\]|\[URL:(?:[a-z0-9.-]+|suspicious)\]|\[NAME_\d+\]")
_GATE_SPACE = str.maketrans(dict.fromkeys("\x1c\x1d\x1e\x1f\x85", " "))


def check_pii(text: str | None, words: frozenset[str] | None = None) -> str | None:
    """Type of the first personal datum or secret that the gate sees, placeholders aside; null if it sees none."""
    if not text:
        return None
    words = dictionary() if words is None else words
    t = _KNOWN.sub(" X ", normalise(text).translate(_GATE_SPACE))
    low = t.lower()
    for kind, ps in _GATE:
        if any(_needed(p, t, low) and p.search(t) for p in ps):
            return kind
    if _CARD_LOOK.search(t) and any(len(d) >= 13 and _luhn(d) for m in _CARD.finditer(t) if (d := re.sub(r"\D", "", m[0]))):
        return "credit_card"
    if _IPV6_LOOK.search(t) and any(c.isdigit() for m in _IPV6.finditer(t) for c in m[0]):
        return "ip"
    if _LONG.search(t) and any(_random(m[0], kind, words) for p, kind in ((_BASE64, "base64"), (_DOTTED, "dotted")) for m in p.finditer(t)):
        return "high_entropy_secret"
    return None


@dataclass(frozen=True)
class Blocklist:
    """Patterns by category, in order."""

    rules: tuple[tuple[str, str], ...]

    @staticmethod
    def load(folder: str | None = None) -> Blocklist:
        """From *.txt files sorted by name: the category is the file's name, lines with # and blank ones are skipped."""
        folder = folder or os.path.join(os.path.dirname(os.path.abspath(__file__)), "blocklists")
        rules = []
        for name in sorted(n for n in os.listdir(folder) if n.endswith(".txt")) if os.path.isdir(folder) else []:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                rules += [(name[:-4], line.strip()) for line in f if line.strip() and not line.startswith("#")]
        return Blocklist(tuple(rules))


_LIKE, _LEET = str.maketrans(P.LIKE_FROM, P.LIKE_TO), str.maketrans(P.LEET_FROM, P.LEET_TO)
_SPACED, _SEP = re.compile(P.SPACED_RUN), re.compile(P.SEPARATOR)


def check_content(text: str | None, rules: list[tuple[str, re.Pattern]]) -> str | None:
    """Category of the first rule that matches the text as it is, with look-alikes folded, or with leet and spacing undone."""
    if not text:
        return None
    t = normalise(text)
    folded = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.category(c).startswith("M")).translate(_LIKE)
    flat = _SEP.sub("", _SPACED.sub(lambda m: re.sub(r"[\s*._\-]+", "", m[0]), folded)).translate(_LEET)
    return next((c for c, p in rules if p.search(t) or p.search(folded) or p.search(flat)), None)


def _series(f):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f, na_action="ignore").astype(object).where(lambda x: x.notna(), None)

    return run


scrub_udf = F.pandas_udf(_series(scrub), StringType())
check_pii_udf = F.pandas_udf(_series(check_pii), StringType())


def _lists(f):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda xs: None if xs is None else [f(x) for x in xs])

    return run


#: The texts of an array, each on its own: turns are scrubbed where they are, without taking a conversation apart and together again.
scrub_all_udf = F.pandas_udf(_lists(scrub), ArrayType(StringType()))


def check_all_udf(rules: Blocklist):
    """Category of the first text of an array that is blocked."""
    compiled: list = []

    def check(xs) -> str | None:
        if not compiled:
            compiled.extend((c, re.compile(p, re.I)) for c, p in rules.rules)
        return next((c for x in xs if (c := check_content(x, compiled))), None)

    return F.pandas_udf(_series(check), StringType())


def gate_all_udf(rules: Blocklist):
    """What the gate says of each text of an array: blocked:<category>, pii:<type> or null."""
    compiled: list = []

    def gate(t: str | None) -> str | None:
        if not compiled:
            compiled.extend((c, re.compile(p, re.I)) for c, p in rules.rules)
        if c := check_content(t, compiled):
            return f"blocked:{c}"
        k = check_pii(t)
        return f"pii:{k}" if k else None

    return F.pandas_udf(_lists(gate), ArrayType(StringType()))


def check_content_udf(rules: Blocklist):
    compiled: list = []

    def check(t: str) -> str | None:
        if not compiled:
            compiled.extend((c, re.compile(p, re.I)) for c, p in rules.rules)
        return check_content(t, compiled)

    return F.pandas_udf(_series(check), StringType())


def register(spark, rules: Blocklist | None = None) -> None:
    """scrub, check_pii and check_content for SQL."""
    spark.udf.register("scrub", scrub_udf)
    spark.udf.register("check_pii", check_pii_udf)
    spark.udf.register("check_content", check_content_udf(rules or Blocklist.load()))
