"""Problem 5: personal data in text, by offset-preserving deobfuscation.

``normalise`` runs transducers over a text: homoglyphs, fullwidth forms and odd dashes and spaces become plain characters, invisible characters vanish, runs of
spelled digits become digits, and at/dot disguises become "@" and ".". It keeps for each character of its output where it comes from. Detectors run
on the output, and their spans are mapped back to the characters of the source.

Names need words: the known names are incomplete, so a first pass over all texts collects capitalised words that stand where a family name follows a known given
name, or a given name precedes a known family name. Words that do so with LEAST_PARTNERS or more different known names, and in at least SHARE of all such places,
are names as well; so there are at most 1 / SHARE of them, which bounds what is sent to the workers.

Results: ``found``: (tbl, rec_id, turn_no, kind, value), value as in the text, each row once. ``redacted``: each text with typed placeholders. Null texts, requests
and turns that don't parse, and null ids give no rows. Placeholders of earlier scrubbing are no case. Overlaps: the kind that
comes first in KINDS wins. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm import stopwords
from turnmill.llm.texts import messages_of, turns_of
from turnmill.session import small, written

KINDS = ("email", "address", "id_number", "phone", "name")
LEAST_PARTNERS = 3
FEW_NAMES = 200_000

# ---------------------------------------------------------------- transducers

# Characters that look like plain ones.
_LIKE = dict(zip("аеорсухіјѕһԁԛԝвкмнтАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "aeopcyxijshdqwbkmhtABEKMHOPCTYXIJSABEZHIKMNOPTYXoav", strict=True))
_PLAIN = {ord(a): b for a, b in _LIKE.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212, 0xFE63)} | {c: " " for c in (0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000)} | {c: str((c - 0x0660) % 16) for c in (*range(0x0660, 0x066A), *range(0x06F0, 0x06FA))}
_GONE = "​‌‍⁠­﻿‎‏"
_UNPLAIN = re.compile("[" + "".join(map(chr, sorted(_PLAIN))) + _GONE + "]")

# Digits as words.
_DIGIT = {w: str(i % 10) for i, ws in enumerate(("zero oh null cero zéro", "one eins uno un um", "two zwei zwo dos deux dois", "three drei tres trois três", "four vier cuatro quatre quatro", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept sete", "eight acht ocho huit oito", "nine neun nueve neuf nove")) for w in ws.split()}
_W = "(?:" + "|".join(sorted(_DIGIT, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"\b{_W}(?:[ ,.-]{{1,2}}{_W}){{5,}}\b")
_SPELLED_ONE = re.compile(_W, re.I)


def _may_spell(low: str) -> bool:
    return sum(map(_DIGIT.__contains__, low.replace("-", " ").replace(",", " ").split())) >= 6


_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_AT = r"(?:\s?[\[({<]\s?(?:at|ät|arroba|arobase)\s?[\])}>]\s?|\s(?:at|AT|At|arroba|arobase)\s|\s?@\s?)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|punkt|punto|point|ponto)\s?[\])}>]\s?|\s(?:dot|DOT|Dot|punkt|punto|point|ponto)\s|\.)"
_DISGUISED = re.compile(rf"(?<![\w.+-])[\w.+'-]*[\w+]{_AT}{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
_AT_OR_DOT = re.compile(rf"{_AT}|{_DOT}", re.I)
#: A bare "at" counts only beside a disguised dot.
_MAY_AT = re.compile(r"\s@|@\s|[\[({<]\s?(?:at|ät|arroba|arobase|dot|punkt|punto|point|ponto)|\s(?:arroba|arobase|dot|punkt|punto|point|ponto)\s", re.I)


class Plain:
    """A normalised text and where its characters come from (None: unchanged offsets)."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text, self.start, self.end = text, start, end

    def back(self, a: int, z: int) -> tuple[int, int]:
        """Source span of the normalised span."""
        return (a, z) if self.start is None else (self.start[a], self.end[z - 1])

    def rewrite(self, changes: list[tuple[int, int, str]]) -> Plain:
        """Spans replaced, in order, each by a text."""
        start = self.start if self.start is not None else list(range(len(self.text)))
        end = self.end if self.end is not None else list(range(1, len(self.text) + 1))
        out, s, e, at = [], [], [], 0
        for a, z, new in changes:
            out += (self.text[at:a], new)
            s += start[at:a] + [start[a]] * len(new)
            e += end[at:a] + [end[z - 1]] * len(new)
            at = z
        out.append(self.text[at:])
        return Plain("".join(out), s + start[at:], e + end[at:])


def normalise(text: str) -> Plain:
    p = Plain(text)
    if not text.isascii() and _UNPLAIN.search(text):
        p = Plain(text.translate(_PLAIN))
        if gone := [(m.start(), m.end(), "") for m in re.finditer(f"[{_GONE}]+", p.text)]:
            p = p.rewrite(gone)
    if _may_spell(low := p.text.lower()) and (found := list(_SPELLED.finditer(low))):
        p = p.rewrite([(m.start(), m.end(), "".join(_DIGIT[w.lower()] for w in _SPELLED_ONE.findall(m[0]))) for m in found])
    if _MAY_AT.search(p.text) and (found := list(_DISGUISED.finditer(p.text))):
        changes = []
        for m in found:
            first = True
            if m[0].lower().count(" at ") and "." in m[0].split(" at ")[-1] and not re.search(r"dot|pun[kt]|po[in]", m[0], re.I):
                continue
            for x in _AT_OR_DOT.finditer(p.text, m.start(), m.end()):
                is_at = "@" in x[0] or re.search(r"at|ät|arro|arob", x[0], re.I) is not None
                if len(x[0]) > 1 and (is_at == first or not is_at):
                    changes.append((x.start(), x.end(), "@" if is_at else "."))
                first = first and not is_at
        if changes:
            p = p.rewrite(changes)
    return p


# ---------------------------------------------------------------- detectors

EMAIL = re.compile(rf"(?<![\w.+-])[\w+][\w.+'-]*@{_LABEL}(?:\.{_LABEL})*\.[^\W\d_]{{2,}}(?![\w-])")

_CAP = r"[A-ZÀ-ÖØ-Þ][\w’'-]*"
# Kinds of streets, by how they stand in an address.
_EN_FULL = r"Street|Road|Avenue|Boulevard|Lane|Drive|Court|Crescent|Terrace|Place|Square|Way|Close|Gardens|Grove|Hill|Row|Walk|Mews|Parade|Circle|Parkway|Highway|Alley|Quay|Rise|Green|Park|Trail|Loop"
_EN_SHORT = r"St|Rd|Ave|Blvd|Ln|Dr|Ct|Cres|Ter|Pl|Sq|Cl|Gdns|Gr|Cir|Pkwy|Hwy"
_FR = r"rue|avenue|av\.|boulevard|bd\.?|boul\.|chemin|ch\.|place|pl\.|impasse|imp\.|allée|all\.|quai|route|rte|cours|passage|square|sentier|ruelle|faubourg|esplanade|promenade"
_ES = r"Calle|C/|C\.|Avenida|Avda\.?|Av\.|Plaza|Pza\.|Paseo|Pº|Camino|Carrera|Ronda|Travesía|Callejón|Rua|R\.|Travessa|Trav\.|Praça|Pç\.|Largo|Lg\.|Estrada|Alameda|Al\.|Beco|Calçada|Rúa|Vía|Via"
_DE = r"straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|chaussee|steig|stieg|pfad|hof|berg|graben|markt|brücke|tor|winkel|zeile"
# Each begins with a plain character class, so that the engine can skip to it; what may not stand before follows as a look behind.
_NUMBER_FIRST = (
    rf"\d(?<![\w.,:/#-]\d)(?<!\d \d)\d{{0,4}}(?:(?<=\d)[a-zA-Z])?,? (?:(?:<CAP>\.? ){{1,4}}?(?:(?:{_EN_FULL})\b|(?:{_EN_SHORT})(?:\.(?=[\s,;:)\"']|$)|\b))(?![\w-])"
    rf"|(?:bis |ter )?(?i:{_FR}) (?:(?i:de la|de l['’]|de|du|des|d['’]|la|le|les|l['’])[ ]?)*<CAP>(?:[ ]<CAP>){{0,3}})"
)
_ES_WORDS = re.compile(rf"(?<!\w)(?i:{_ES})[ ]?(?:(?i:de la|de los|de las|del|de|do|da|dos|das|la|el|los|las)[ ])*{_CAP}(?:[ ]{_CAP}){{0,3}},?[ ](?:(?i:n[.ºo°]{{1,2}}|núm\.|número|numero)[ ]?)?\d{{1,5}}(?:[a-zA-Z])?(?![\w-])")
_DE_WORDS = re.compile(rf"[A-ZÄÖÜ](?<![\w-].)[\w-]*(?: (?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring|Damm|Ufer))?\.?[ ]\d{{1,4}}(?:[ ]?[a-z](?!\w))?(?![\w]|[.-]\d)")
_DE_END = re.compile(rf"(?i:{_DE})[ ]\d")
_EN_CAP = re.compile(_NUMBER_FIRST.replace("<CAP>", _CAP))
_EN_LOOSE = re.compile(_NUMBER_FIRST.replace("<CAP>", r"(?!(?:the|a|an|of|and|or|to|in|on|is|are|was|more)\b)[\w’'-]+"), re.I)
#: Their beginnings alone: looked for before the expression is run.
_ES_HINT = re.compile(rf"(?<!\w)(?:{_ES})", re.I)
#: What such an address ends in.
_CAP_NUMBER = re.compile(r"[A-ZÀ-ÖØ-Þ][\w’'-]*,?[ ](?:(?i:n[.ºo°]{1,2}|núm\.|número|numero)[ ]?)?\d")


def addresses(text: str, low: str) -> Iterator[tuple[int, int]]:
    loose = text == low or text.isupper()
    for m in (_EN_LOOSE if loose or _SHOUTED.search(text) else _EN_CAP).finditer(text):
        if re.search(r"\w\w\. ", m[0]) or not _FUNCTION.isdisjoint(m[0].lower().split()[1:-1]) and not re.search(_FR, m[0], re.I):
            continue
        if loose or m[0] == m[0].upper() or _EN_CAP.match(text, m.start()):
            yield m.span()
    if _CAP_NUMBER.search(text) and _ES_HINT.search(text):
        for m in _ES_WORDS.finditer(text):
            yield m.span()
    for m in _DE_WORDS.finditer(text):
        if _DE_END.search(m[0]):
            yield m.span()


_FUNCTION = {w for x in stopwords.WORDS.values() for w in x.split()} - {"west", "east"}
_SHOUTED = re.compile(r"\d [A-Z]{2,} [A-Z]{2,}")

# Shapes of the numbers of identity documents.
ID_SHAPE = re.compile(
    r"\d(?<![\w.+/-]\d)(?<!\d \d)(?:\d{2}-\d{2}-\d{4}|\d{2} \d{2} \d{4}(?! ?\d)|\d?\.\d{3}\.\d{3}-[\dA-Za-z]|\d{7}-?[A-Z]|\d{2}\.\d{3}\.\d{3}-\d{2}|(?<=[12]) \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?)(?![\w/]|[-.]\d)"
    r"|[A-Z](?<![\w.+/-][A-Z])(?:[A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|(?<=[XYZ])-?\d{7}-?[A-Z]|(?=[A-Z\d]*\d[A-Z\d]*\d)[A-Z\d]{8}\d?)(?![\w/]|[-.]\d)"
)
# What announces such a number.
ID_LABEL = re.compile(
    r"(?i:passport|identity|identification|id[ -]?card|social security|national insurance|tax|driver['’]?s? licen[cs]e|driving licen[cs]e|citizen|ausweis|personalausweis|reisepass|steuer|sozialversicherungs?|identidad|identidade|dni|nie|nif|cpf|ssn|pasaporte|passaporte|passeport|carte d['’]identité|identité|cédula|sécurité sociale|\bdoc|\bid)(?i:[\w-]*(?:[ ](?:number|no\.?|nr\.?|card|nummer|num|n[º°o]\.?|code))?[\"']?(?:[ ](?:is|which is|reads?|lautet|est|es|é|on the \w+ reads|ist|was|of|:))?)[ :=#\"']{1,4}"
    r"(?P<v>(?=(?:[A-Za-z]{0,3}[ ./-]?\d){5})(?:[A-Z]{0,3}\d[A-Z\d]{0,11}|[A-Z]{1,3})(?:[ ./-](?:\d{1,9}[A-Z]{0,2}|[A-Z])(?![a-z])){0,6})(?![\w/]|[-.]\d)"
)
THING = re.compile(r"(?:serial|order|invoice|ticket|build|version|row id|error|chapter|isbn|sku|tracking|parcel|batch|model)(?: (?:no|number|code|id))?[ #:.]{1,3}$", re.I)

PHONE_RUN = re.compile(r"[+(\d](?<![\w.:/#+(-][+(\d])(?<!\d,\d)(?<!\d [\d(])(?:(?<=\d)|(?<=[+(])\+?\d)(?:[ ]?[()/.\-][ ]?|[ ])?(?:\d(?:[ ]?[()/.\-][ ]?|[ ])?){5,15}\d(?![\w:/]|[.-]\d)")
DATE = re.compile(r"^(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}$|^\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d\d$")
PHONE_LABEL = re.compile(r"(?:phone|call|tel|tél|telef\w*|mobile|cell|fax|dial|text|ring|reach|line|number|anruf\w*|erreich\w*|telefon\w*|joindre|joignable|appel\w*|móvil|llam\w*|lig\w*|contact\w*|whatsapp|sms|handy)\b[^\d+(]{0,30}$", re.I)


def is_phone(run: str, before: str) -> bool:
    digits = sum(c.isdigit() for c in run)
    if DATE.match(run) or not 7 <= digits <= 15:
        return False
    groups = [len(x) for x in re.findall(r"\d+", run)]
    marks = set(re.findall(r"[^\d ]", run))
    if run[0] == "+":
        return digits >= 8
    if re.fullmatch(r"\(?\+?1?\)?[ .-]?\(?[2-9]\d{2}\)?[ .-]{1,2}\d{3}[ .-]\d{4}", run):
        return True
    if marks <= {"."} and len(groups) == 4 and max(groups) <= 3:
        return False  # an address of a machine or a version
    if run[0] in "0(" and digits >= 9 and len(groups) >= 2 and (groups[0] >= 2):
        return True
    if digits >= 9 and len(groups) >= 3 and min(groups) >= 2 and PHONE_LABEL.search(before):
        return True
    return len(groups) == 1 and digits in (10, 11) and bool(PHONE_LABEL.search(before))


# Titles, and words that stand before a name.
TITLES = set("mr mrs ms miss mx dr prof sir madam dame lord lady herr herrn frau fräulein monsieur madame mademoiselle m mme mlle señor señora señorita sr sra srta don doña senhor senhora dona doutor doutora dr. prof. dear hello hi hallo liebe lieber bonjour hola olá cher chère estimado estimada querido querida caro cara sehr".split())
CUES = set("for with by from as tell told am is name named called sign signed regards sincerely thanks contact invoice ask asked meet met invite email call phone heiße heißt bin grüßen gruß llamo llama soy appelle suis chamo chama sou cordialement atentamente cumprimentos me applicant patient holder customer client user employee yesterday and und et y e o a to zu von de".split())
#: Ordinary words that are also given names (fixed values).
ORDINARY = set("will mark rose grace bill joy frank ivy brisk hope faith may june april august dawn lily daisy violet pearl ruby amber jade olive hazel iris art gene jack rob pat chase hunter mason carter cooper dean drew grant guy jay lance miles pierce ray reed rusty sandy skip sterling summer autumn victor wade ward penny robin sunny max don sue".split())
PERSON_VERBS = set("said says from has had is was wants wanted asked told called wrote lives works and who will called needs hat ist war sagte und a est était et dit ha es era y dijo tem é disse e turns".split())

ELEMENT = re.compile(r"[A-ZÀ-ÖØ-Þ](?<![\w@’'-].)(?:\.(?=[ ]?[A-ZÀ-Þ])|[\w’'-]*\w)")
WORDS = re.compile(r"[A-ZÀ-ÖØ-Þ][\w’'-]*\w")
PAIR = re.compile(rf"([A-ZÀ-ÖØ-Þ](?<![\w@’'-].)[\w’'-]*) (?:[A-Z]\. )*(?=({_CAP}))")


class Names:
    """Given and family names, lower case."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family
        self.all = given | family
        # names in lower or mixed case are looked for by their words
        both = ["(?:" + "|".join(map(re.escape, sorted(x, key=len, reverse=True))) + ")" for x in (given, family)]
        self.any = re.compile(rf"(?<![\w’'@-]){both[0]} (?:[a-z]\. )?{both[1]}(?![\w’'@-])") if given and family else None

    @staticmethod
    def of(rows) -> Names:
        return Names({r["word"] for r in rows if r["kind"] == "given"}, {r["word"] for r in rows if r["kind"] != "given"})

    def spans(self, text: str, low: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        if text == low:
            # a text without capitals: two names in a row
            if self.any:
                out = [m.span() for m in self.any.finditer(text)]
        elif not self.all.isdisjoint(w.lower().removesuffix("'s").removesuffix("’s") for w in WORDS.findall(text)):
            out = self._capital(text)
        if text != low and self.any:
            w = text.split()
            # names in lower case count only as given and family name in a row
            if any(a in self.given and (b.rstrip(".,;:?!") in self.family or b[1:] == ".") for a, b in zip(w, w[1:], strict=False)):
                out += [m.span() for m in self.any.finditer(text)]
        return [(a, z) for a, z in out if not any(s < z and a < e for s, e in taken)]

    def _kind(self, low: str) -> str:
        return "g" if low in self.given else "f" if low in self.family else ""

    def _capital(self, text: str) -> list[tuple[int, int]]:
        parts = []  # start, end, lower case, g(iven) / f(amily) / i(nitial) / u(nknown)
        for m in ELEMENT.finditer(text):
            w = m[0]
            if w[-2:] in ("'s", "’s"):
                w = w[:-2]
            low = w.lower()
            kind = "i" if w[1:] == "." else self._kind(low) or ("u" if len(w) > 2 and not (_PART.search(w) or low in TITLES or low in CUES or low in ORDINARY) else "")
            if kind:
                parts.append((m.start(), m.start() + len(w), low, kind))
        out = []
        i = 0
        while i < len(parts):
            j = i
            while j + 1 < len(parts) and (gap := text[parts[j][1] : parts[j + 1][0]]) in (" ", ", ", "") and (gap != "" or parts[j][3] == "i") and (gap != ", " or (j == i and parts[i][3] in "fu" and parts[j + 1][3] == "g")):
                j += 1
            found = self._name(text, parts[i : j + 1])
            if found:
                out.append(found)
            i = j + 1
        return out

    def _name(self, text: str, run: list[tuple[int, int, str, str]]) -> tuple[int, int] | None:
        """The name in a run of capitalised words and initials."""
        kinds = "".join(k for *_, k in run)
        if not ("g" in kinds or "f" in kinds):
            return None
        shout = text[run[0][0] : run[-1][1]].isupper()
        begins = _begins(text, run[0][0])
        unknown = "" if shout else "u"
        # "Surname, Given", with an initial at most; an unknown surname only inside a sentence
        if len(run) > 1 and text[run[0][1] : run[1][0]] == ", ":
            if kinds[0] == "f" or (unknown and not begins):
                n = 3 if kinds[2:3] == "i" else 2
                return run[0][0], run[n - 1][1]
            run, kinds, begins = run[1:], kinds[1:], True
        # an unknown word stands for a given name only before (an initial and) a family name, for a family name only after a given one
        m = re.search(rf"gi*[gf{unknown}]|[{'u' if unknown else 'g'}]i+f|i+f|gi*f", kinds)
        if unknown and not m and (x := re.search("uf", kinds)) and not (begins and x.start() == 0):
            m = x
        if m:
            a, z = m.span()
            if kinds[a] == "g" and run[a][2] in ORDINARY and kinds[z - 1] == "u" and (begins or "i" not in kinds[a:z]):
                return None
            return run[a][0], run[z - 1][1]
        for a, z, low, kind in run:
            if kind in "gf" and self._alone(text, a, z, low):
                return a, z
        return None

    def _alone(self, text: str, a: int, z: int, low: str) -> bool:
        """Whether a single name is one."""
        before = text[max(0, a - 40) : a].rstrip(" ")
        prev = re.findall(r"[\w’'-]+\.?|[^\w\s]", before)
        last = prev[-1].lower() if prev else ""
        if last.rstrip(".") in TITLES:
            return True
        if last in ("in", "near", "at", "bei", "em", "en", "à"):
            return False  # a place
        if low not in ORDINARY:
            return True
        after = re.match(r"[\s,]*([\w’'-]+)", text[z:])
        follow = after[1].lower() if after else ""
        if text[a:z].isupper():
            return False
        if _begins(text, a):
            return follow in PERSON_VERBS and low not in ("will", "may") and (follow not in ("is", "was", "and", "from", "a", "e", "y", "et", "und", "works") or text[z : z + 1] == ",")
        return last in CUES or text[z : z + 5].startswith((", who", ", der", ", die", ", qui", ", que"))


def _begins(text: str, a: int) -> bool:
    """Whether a sentence or line begins at a."""
    before = text[max(0, a - 3) : a]
    return not before.strip() and (not before or "\n" in before or a <= 3) or before.rstrip(" \"“'")[-1:] in (".", "?", "!", ":", ";", "\n", "|", ">", "…", "¿", "¡")


#: A word with a lower-case part behind a hyphen is a verb and its pronoun, not a name.
_PART = re.compile(r"-[a-zß-ÿ]")


def learn(df: DataFrame, known: DataFrame) -> DataFrame:
    """(word, kind), written: the known names, and words that stand like family or given names beside them (see above)."""
    names = known.where("name is not null").select(F.lower("name").alias("word"), F.when(F.col("kind") == "given", "given").otherwise("family").alias("kind")).distinct()
    few = names.select("word").distinct().limit(FEW_NAMES + 1).collect()
    # a first look at the pairs where they are found: one of the two must be known
    look = df.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in few) if len(few) <= FEW_NAMES else None)
    pairs = written(df.select("tbl", "body").mapInArrow(lambda batches: _pairs(batches, look.value), "word string, kind string, partner string").distinct(), "pairs")
    # a pair of words counts if one of them is a known name of its kind, and the other is not known
    other = pairs.select(F.col("word").alias("x"), F.col("partner").alias("y"), F.col("kind").alias("begins"))
    g, f = (names.where(f"kind = '{k}'").select(F.col("word").alias(c)) for k, c in (("given", "x"), ("family", "y")))
    everyone = names.select("word").distinct()
    families = other.join(small(g), "x").join(small(everyone.withColumnRenamed("word", "y")), "y", "left_anti").select(F.col("y").alias("word"), F.lit("family").alias("kind"), F.col("x").alias("partner"))
    givens = other.where("begins = 'inside'").join(small(f), "y").join(small(everyone.withColumnRenamed("word", "x")), "x", "left_anti").where(~F.col("x").isin(*TITLES, *CUES)).select(F.col("x").alias("word"), F.lit("given").alias("kind"), F.col("y").alias("partner"))
    both = families.unionByName(givens).groupBy("word", "kind").agg(F.count_distinct("partner").alias("n")).where(F.col("n") >= LEAST_PARTNERS).select("word", "kind")
    return written(names.unionByName(both).distinct(), "names")


def _pairs(batches: Iterator[pa.RecordBatch], known: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Capitalised words in a row, of which one at least is known (if it is told what is): the first, whether it begins a sentence, the second."""
    seen: set[tuple[str, str, str]] = set()
    for b in batches:
        for tbl, body in zip(b["tbl"].to_pylist(), b["body"].to_pylist(), strict=True):
            for _, text in _texts(tbl, body):
                for m in PAIR.finditer(text):
                    x, y = m[1].lower(), m[2].lower()
                    if known is not None and x not in known and y not in known:
                        continue
                    if not (m[1].isupper() or x in ORDINARY or y in ORDINARY or _PART.search(m[1])):
                        seen.add((x, "begins" if _begins(text, m.start()) else "inside", y))
        if len(seen) > 200_000:
            yield _counted(seen)
            seen.clear()
    yield _counted(seen)


def _counted(seen: set[tuple[str, str, str]]) -> pa.RecordBatch:
    k = sorted(seen)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in k], pa.string()) for i in range(3)], ["word", "kind", "partner"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tbl, rec_id, word): the words of each record that may be names."""
    for b in batches:
        rows = {(tbl, rec, w.lower()) for tbl, rec, body in zip(*(b[c].to_pylist() for c in ("tbl", "rec_id", "body")), strict=True) for _, text in _texts(tbl, body) for w in _NAME_WORD.findall(normalise(text).text)}
        rows |= {(t, r, w[:-2]) for t, r, w in rows if w[-2:] in ("'s", "’s")}
        k = sorted(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.int32()), pa.array([x[1] for x in k], pa.string()), pa.array([x[2] for x in k], pa.string())], ["tbl", "rec_id", "word"])


_NAME_WORD = re.compile(r"[^\W\d_](?:[\w’'-]*\w)?")


def named(df: DataFrame, names: DataFrame) -> tuple[DataFrame, object]:
    """df with a column ``names``, and the names as a broadcast. Few names are broadcast and the column is null; of many each record gets those among its words."""
    rows = names.limit(FEW_NAMES + 1).collect()
    spark = df.sparkSession
    if len(rows) <= FEW_NAMES:
        return df.withColumn("names", F.lit(None).cast("array<struct<word:string,kind:string>>")), spark.sparkContext.broadcast(Names.of(rows))
    own = df.select("tbl", "rec_id", "body").mapInArrow(_words, "tbl int, rec_id string, word string").distinct().join(names, "word").groupBy("tbl", "rec_id").agg(F.collect_set(F.struct("word", "kind")).alias("names"))
    return df.join(own, ["tbl", "rec_id"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<struct<word:string,kind:string>>"))), spark.sparkContext.broadcast(None)


def spans(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the source text, in order, without overlap."""
    p = normalise(text)
    t = p.text
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(a: int, z: int, kind: str) -> None:
        if not any(s < z and a < e for s, e in taken):
            taken.append((a, z))
            out.append((*p.back(a, z), kind))

    low = t.lower()
    if "@" in t:
        for m in EMAIL.finditer(t):
            add(m.start(), m.end(), "email")
    if _DIGIT_ANY.search(t):
        for a, z in addresses(t, low):
            add(a, z, "address")
        for m in ID_SHAPE.finditer(t):
            if not THING.search(t[max(0, m.start() - 24) : m.start()]):
                add(m.start(), m.end(), "id_number")
        if _FIVE.search(t) and _ID_HINT.search(t):
            for m in ID_LABEL.finditer(t):
                v = m["v"]
                if not DATE.match(v) and not re.search(r"row[ _]id|order|error", m[0], re.I) and not re.search(r"(?:row|order|error|line|session|user|message|request|process)[ _-]?$", t[: m.start()][-12:], re.I):
                    add(m.start("v"), m.start("v") + len(v), "id_number")
        for m in PHONE_RUN.finditer(t):
            run, a = m[0], m.start()
            if run.count("(") == run.count(")") and is_phone(run, t[max(0, a - 50) : a]) and not THING.search(t[max(0, a - 24) : a]):
                add(a, m.end(), "phone")
    for a, z in names.spans(t, low, taken + [m.span() for m in _PLACEHOLDER.finditer(t)] if "[" in t else taken):
        add(a, z, "name")
    return sorted(out)


_DIGIT_ANY = re.compile(r"\d")
#: The five digits that the number after a label has, with what may stand between them.
_FIVE = re.compile(r"\d(?:[A-Za-z]{0,3}[ ./-]?\d){4}")
#: The labels that ID_LABEL begins with, without what follows.
_ID_HINT = re.compile(ID_LABEL.pattern[: ID_LABEL.pattern.index("(?i:[")].removeprefix("(?i:").removesuffix(")"), re.I)
_PLACEHOLDER = re.compile(r"\[[A-Z][A-Z_]*(?:_\d+)?(?::[^\]]*)?\]")


def _texts(tbl: int, body: str | None) -> Iterator[tuple[int, str]]:
    if tbl == 0:
        m = messages_of(body)
    elif tbl == 1:
        m = turns_of(body)
    else:
        m = [(None, x) for x in json.loads(body)] if body else None
    for i, (_, text) in enumerate(m or []):
        if text:
            yield i, text


TABLES = ("exchanges", "staged", "sample_messages")


def bodies(exchanges: DataFrame, staged: DataFrame, samples: DataFrame) -> DataFrame:
    """(tbl, rec_id, body) of the three tables."""
    a = exchanges.where("id is not null").select(F.lit(0).alias("tbl"), F.col("id").cast("string").alias("rec_id"), F.col("request_json").alias("body"))
    b = staged.where("id is not null").select(F.lit(1).alias("tbl"), F.col("id").cast("string").alias("rec_id"), F.col("scrubbed_turns").alias("body"))
    # null messages and contents keep their places
    c = samples.where("line_no is not null").select(F.lit(2).alias("tbl"), F.col("line_no").cast("string").alias("rec_id"), F.to_json(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit("")))).alias("body"))
    return a.unionByName(b).unionByName(c)


def once(df: DataFrame) -> DataFrame:
    """Repeated rows of a record once, without a shuffle of the others' texts."""
    again = written(df.groupBy("tbl", "rec_id").count().where("count > 1").select("tbl", "rec_id"), "again")
    return df.join(small(again), ["tbl", "rec_id"], "left_anti").unionByName(df.join(small(again), ["tbl", "rec_id"], "left_semi").distinct())


def _records(b: pa.RecordBatch, shared: object) -> Iterator[tuple[int, str, str, Names]]:
    """(tbl, rec_id, body, names) of the rows of a batch."""
    for tbl, rec, body, own in zip(*(b[c].to_pylist() for c in ("tbl", "rec_id", "body", "names")), strict=True):
        yield tbl, rec, body, shared.value if own is None else Names.of(own)


def found(exchanges: DataFrame, staged: DataFrame, samples: DataFrame, known: DataFrame) -> DataFrame:
    df = bodies(exchanges, staged, samples)
    df, shared = named(df, learn(df, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(TABLES[tbl], rec, i, kind, text[a:z]) for tbl, rec, body, names in _records(b, shared) for i, text in _texts(tbl, body) for a, z, kind in spans(text, names)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["tbl", "rec_id", "turn_no", "kind", "value"])

    return df.mapInArrow(run, "tbl string, rec_id string, turn_no long, kind string, value string").distinct()


def redact(text: str, names: Names) -> str:
    """The text with typed placeholders; the same value gets the same number within the text."""
    out, at = [], 0
    numbers: dict[tuple[str, str], int] = {}
    for a, z, kind in spans(text, names):
        n = numbers.setdefault((kind, text[a:z].casefold()), sum(k == kind for k, _ in numbers) + 1)
        out += (text[at:a], f"[{kind.upper()}_{n}]")
        at = z
    return "".join([*out, text[at:]])


def redacted(exchanges: DataFrame, staged: DataFrame, samples: DataFrame, known: DataFrame) -> DataFrame:
    """(tbl, rec_id, turn_no, text): every text of the three tables with typed placeholders."""
    df = bodies(exchanges, staged, samples)
    df, shared = named(once(df), learn(df, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(TABLES[tbl], rec, i, redact(text, names)) for tbl, rec, body, names in _records(b, shared) for i, text in _texts(tbl, body)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["tbl", "rec_id", "turn_no", "text"])

    return df.mapInArrow(run, "tbl string, rec_id string, turn_no long, text string")
