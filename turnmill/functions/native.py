"""Functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.functions import patterns as P

TURNS = "array<struct<role:string,content:string>>"


def replace_matches(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """text with each match m of the pattern replaced by new(m). Gaps and matches alternate, so they are zipped; the pattern must not match the empty string."""
    gaps = F.split(text, pattern, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), new)
    return F.array_join(F.zip_with(gaps, matches, lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit("")))), "")


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), P.SPACE + "+"), lambda w: w != "")


def entropy(text: Column) -> Column:
    """Bits a character; 0 for the empty string."""
    chars = F.split(F.substring(text, 1, P.ENTROPY_SAMPLE), "")
    n = F.size(chars)
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))
    return F.when(F.length(text) == 0, 0.0).otherwise(F.abs(total))


def reduce_urls(text: Column) -> Column:
    """[URL:host], host in lower case, or [URL:suspicious]."""

    def one(m: Column) -> Column:
        host = F.lower(F.regexp_extract(m, P.URL, 1))
        bad = F.substring_index(host, ".", -1).isin(P.SPAM_TLDS) & host.contains(".")
        return F.concat(F.lit("[URL:"), F.when(bad, "suspicious").otherwise(host), F.lit("]"))

    return replace_matches(text, P.URL, one)


def redact_cards(text: Column) -> Column:
    """[CREDIT_CARD] for numbers of 13 digits or more that pass the Luhn check; a separator after the number goes with it."""
    return replace_matches(text, P.CARD, lambda m: F.when(F.call_function("luhn_check", F.regexp_replace(m, "[ -]", "")), F.lit("[CREDIT_CARD]")).otherwise(m))


def captured_path(path: Column) -> Column:
    """Whether traffic to the path is captured: query and trailing slashes aside, it ends in one of the endpoints."""
    bare = F.regexp_replace(F.substring_index(path, "?", 1), "/+$", "")
    hit = F.lit(False)
    for p in P.CAPTURED:
        hit = hit | bare.endswith(p)
    return hit


def content_blocks(blocks: Column) -> Column:
    """Text of a content that is a string or a JSON array of text blocks: non-blank values, stripped, joined by line ends; else ""."""
    v = F.try_parse_json(blocks)
    kind = F.schema_of_variant(v)
    items = F.from_json(blocks, "array<struct<type:string,text:string>>")
    value = lambda b: F.trim(F.coalesce(F.get_json_object(b["text"], "$.value"), F.when(~F.coalesce(b["text"], F.lit("")).startswith("{"), b["text"]), F.lit("")))
    joined = F.array_join(F.filter(F.transform(F.filter(items, lambda b: b["type"] == "text"), value), lambda t: t != ""), "\n")
    return F.when(kind == "STRING", F.trim(F.variant_get(v, "$", "string"))).when(kind.startswith("ARRAY"), joined).otherwise(F.lit(""))


def share_role(role: Column) -> Column:
    """user, assistant and system for human, gpt and system; null for others."""
    return F.when(role == "human", "user").when(role == "gpt", "assistant").when(role == "system", "system")


def ladder(scores: dict[str, Column]) -> Column:
    """The first category, in order, whose score is over its threshold, as ml_<category>."""
    return F.coalesce(*(F.when(scores[c] > t, F.lit(f"ml_{c}")) for c, t in P.TOXICITY if c in scores))


def as_uuid(hex32: Column) -> Column:
    """32 hexadecimal digits in the grouping of a UUID."""
    return F.regexp_replace(hex32, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
