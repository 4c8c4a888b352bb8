"""Language of a text behind an interface. The default backend votes by function words, in the JVM; a model may take its place."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from turnmill.functions import native as N

#: Function words that tell the languages apart.
WORDS = {
    "de": "der die das und ist nicht ein eine einen einem einer mit auf den dem von zu zum zur wir sie auch wenn aber oder als wie für noch nur nach bei sich ich es im aus werden wird hat haben kann man über diese dieser weil dass",
    "en": "the and is of to in that it with for are this was you have which when but or as how not be on at by from an if we they can will would there their has been what so more than your do does it's",
    "es": "el los las una uno que del con por para pero como más este esta son está hay y en un se lo su sus al es muy también cuando porque ya si sin sobre entre desde hasta puede tiene ser donde",
    "fr": "le les des une est et dans pour pas que qui sur avec vous nous mais la un du ce cette ces il elle au aux par plus ne se sont être ont fait comme ou où très aussi quand parce donc",
    "pt": "os uma que não com para mas mais como são está dos das pelo também o um do da no na em se ao por foi ser tem muito quando já ou seu sua ele ela isso este esta entre depois até porque",
}
LEAST = 0.65


class Backend(Protocol):
    def top(self, text: str) -> tuple[str, float]: ...


class FunctionWords:
    """The language with most function words, and its share of all votes; ties go to the name that comes last."""

    def __init__(self) -> None:
        self.words = {k: frozenset(v.split()) for k, v in WORDS.items()}

    def top(self, text: str) -> tuple[str, float]:
        w = text.lower().split()
        votes = {k: sum(x in s for x in w) for k, s in self.words.items()}
        best = max(votes, key=lambda k: (votes[k], k))
        total = sum(votes.values())
        return best, votes[best] / total if total else 0.0


def identify(text: str | None, backend: Backend) -> str:
    """unknown for blank texts and below LEAST."""
    t = (text or "").replace("\n", " ").strip()
    if not t:
        return "unknown"
    lang, score = backend.top(t)
    return lang if score >= LEAST else "unknown"


def language(text: Column, backend: Backend | None = None) -> Column:
    """Language of a text, unknown for null and blank ones and where no language has LEAST of the votes. Without a backend: ``FunctionWords`` as an expression."""
    if backend is not None:

        @F.pandas_udf(StringType())
        def f(s: pd.Series) -> pd.Series:
            return s.map(lambda t: identify(t, backend))

        return f(text)
    words = N.words(F.coalesce(text, F.lit("")))

    def votes_of(known: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*known)))

    votes = F.array(*(F.struct(votes_of(v.split()).alias("n"), F.lit(k).alias("lang")) for k, v in WORDS.items()))
    # the votes once, then the best and the sum of them
    return F.transform(F.array(votes), lambda v: F.when(F.array_max(v)["n"] >= LEAST * F.greatest(F.aggregate(v, F.lit(0), lambda a, x: a + x["n"]), F.lit(1)), F.array_max(v)["lang"]).otherwise("unknown")).getItem(0)
