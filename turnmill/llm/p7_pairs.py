"""Problem 7: broken prompt and response pairs.

Each exchange gets at most one defect, the first that holds:

- ``empty``: the answer has no visible character.
- ``refusal``: every sentence of the answer is accepted by the refusal or the courtesy automaton (compiled patterns over five languages), one at least by the former.
- ``echo``: the answer runs through the suffix automaton of the words of the last user message; the words in common runs of RUN words or more
  make up most of the answer and a good part of the message; an answer of under four words is an echo if its words are those of the message.
- ``wrong_language``: votes of function words give the answer one language and the user another, and the user names the answer's language nowhere.
- ``truncated``: a code fence is left open (a stack of delimiters), or the last line is prose and stops without an end: no list, table, junk or sign-off.

Exchanges whose request or response doesn't parse, or without an id, have no defect. Redelivered ids count once. Without a user message
there is no echo and no wrong language. Texts are looked at whole. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm import stopwords
from turnmill.llm.texts import answer_of, messages_of, mix, word_arrays

RUN = 3
COPIED_ANSWER, COPIED_PROMPT = 0.7, 0.3

INVISIBLE = re.compile(r"[\s­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁦-⁯⠀ㅤ︀-️﻿ﾠ￹-￻]+")
SENTENCE = re.compile(r"(?<=[.?!…])[\"'”»)\]]*\s+|\n+")

# How assistants decline, by language.
REFUSAL = re.compile(
    "|".join(
        (
            r"\bi(?:['’]m| am)? (?:really |truly |very )?(?:sorry|afraid),? (?:but )?(?:i|this|that|it)\b.*\b(?:can(?:['’]|no)?t|won['’]?t|unable|not able|decline|against)\b",
            r"\b(?:i|we) (?:can(?:['’]t|not)|could not|will not|won['’]t|am unable to|am not able to|['’]m not able to|['’]m unable to|may not) (?:help|assist|provide|answer|discuss|continue|comply|do|fulfil|fulfill|support|respond|share|talk|engage|go)\b",
            r"\b(?:unfortunately|regrettably|sorry)\b.*\b(?:not able|unable|cannot|can['’]t|won['’]t|not allowed|not permitted)\b",
            r"\b(?:i|we) (?:must|have to|need to|will have to) (?:decline|refuse|stop here|leave (?:this|that|it) alone)\b",
            r"\btopic (?:that )?i (?:have to|must|would rather) (?:leave|avoid)\b",
            r"\bi(?:['’]d| would) (?:rather|prefer) not\b",
            r"\b(?:is|it['’]s) not something (?:that )?i (?:can|am able to|may)\b",
            r"\bwould (?:not|n['’]t) be (?:appropriate|right|ethical)\b|\bwouldn['’]t be (?:appropriate|right|ethical)\b",
            r"\b(?:goes|go|is|are) against (?:my|the|our) (?:guidelines|policy|policies|rules|principles)\b",
            r"\b(?:break|violate|breach)\w* (?:the|my|our) (?:rules|guidelines|polic\w+)\b",
            r"\b(?:policy|policies|guidelines|rules)\b.*\b(?:not allow|don['’]t allow|doesn['’]t allow|not permit|prohibit|forbid|prevent)",
            r"\boutside (?:of )?what i (?:may|can|am)\b",
            r"\b(?:tut mir leid|bedau[re]\w+|leider)\b.*\b(?:nicht|kein\w*)\b|\bdarf ich .*\bnicht\b|\bkann ich (?:ihnen|dir|dabei|hier|das|diese)\b.*\bnicht\b|\bmuss ich (?:ablehnen|leider ablehnen)\b|\bgegen (?:meine|die) (?:richtlinien|regeln)\b",
            r"\b(?:lo siento|lamentablemente|lamento|por desgracia|disculpa)\b.*\bno\b|\bno (?:puedo|podré|me está permitido|me es posible|estoy autorizad[oa])\b.*\b(?:ayudar\w*|responder\w*|hacer\w*|continuar|petición|solicitud|esto|eso)\b|\bva en contra de mis\b|\bdebo rechazar\b",
            r"\b(?:désolée?|malheureusement|je regrette|navrée?)\b.*\b(?:ne|n['’]|pas)\b|\bje ne (?:peux|puis|suis|saurais)\b.*\b(?:pas|aider|répondre|autorisée?)\b|\bje dois (?:refuser|décliner)\b|\bcontraire à mes\b",
            r"\b(?:lamento|desculpe|desculpa|infelizmente|sinto muito)\b.*\bnão\b|\bnão (?:posso|consigo|me é permitido|estou autorizad[oa]|tenho permissão)\b.*\b(?:ajudar\w*|responder\w*|fazer|continuar|pedido|isso|isto|aqui)\b|\btenho de recusar\b|\bvai contra as minhas\b",
        )
    ),
    re.I,
)
# What stands beside a refusal.
COURTESY = re.compile(
    r"^(?:thank(?:s| you)\b|feel free\b|is there (?:anything|something) else\b|please (?:consult|contact|ask|reach|feel|try|let me know|see)\b|let me know\b|i (?:hope|appreciate|understand)\b|if you (?:have|need|want|would)\b|(?:happy|glad) to\b|i(?:['’]m| am) (?:happy|glad) to\b|you (?:can|may|could) (?:always )?(?:ask|contact|consult|try)\b|sorry\b|my apologies\b"
    r"|gibt es (?:sonst|noch)\b|kann ich (?:sonst|dir sonst|ihnen sonst)\b|bitte (?:wenden|fragen|wende|frag)\b|sie können (?:mich|gern)\b|gerne? \b|danke\b|vielen dank\b|ich hoffe\b"
    r"|¿?(?:hay|puedo)\b.*\b(?:otra cosa|algo más|ayudarte en otra)\b|¿?hay (?:algo|alguna otra)\b|por favor,? (?:consult|pregunt|contact)\w*|gracias\b|puedes pregunt\w+|no dudes en\b|espero que\b"
    r"|y a-t-il\b|(?:puis|est-ce que je peux)\b.*\bautre chose\b|n['’]hésitez pas\b|veuillez (?:consulter|contacter)\b|merci\b|vous pouvez (?:me )?(?:demander|poser|consulter)\b|j['’]espère\b"
    r"|há (?:mais )?(?:alguma|algo|outra)\b|posso (?:ajudar|fazer)\b.*\b(?:mais|outra coisa)\b|por favor,? (?:consulte|contacte|pergunte|procure)\b|obrigad[oa]\b|fique à vontade\b|esteja à vontade\b|sinta-se à vontade\b)",
    re.I,
)
# How answers sign off without a full stop.
SIGN_OFF = re.compile(
    r"^(?:let me know\b|happy to\b|glad to\b|hope (?:this|that|it)\b|i hope\b|good luck\b|best(?:\s|$)|kind regards\b|regards\b|cheers\b|thanks\b|thank you\b|take care\b|have (?:a|fun)\b|enjoy\b|see you\b|all the best\b|talk soon\b|yours\b|sincerely\b|you['’]re welcome\b|feel free\b|any (?:more )?questions\b|ask away\b|more (?:on request|if needed)\b"
    r"|viel (?:erfolg|spaß|glück)\b|(?:ich )?hoffe,? (?:das|dass|es)\b|das hoffe ich\b|(?:liebe|viele|beste|mit freundlichen|freundliche|schöne) grüße?n?\b|bis (?:bald|dann)\b|gerne (?:mehr|wieder)\b|melde? dich\b|melden sie sich\b|alles gute\b|sag (?:mir )?bescheid\b"
    r"|(?:mucha )?suerte\b|espero que (?:esto|te|le|ayude|sirva)\b|(?:un )?(?:saludos?|abrazo)\b|hasta (?:luego|pronto)\b|avísame\b|ya me (?:dirás|contarás)\b|de nada\b|quedo a\b"
    r"|bonne (?:chance|journée|continuation)\b|(?:en )?espérant\b|j['’]espère que\b|cordialement\b|à bientôt\b|bien à vous\b|dites-moi\b|dis-moi\b|n['’]hésitez pas\b|n['’]hésite pas\b"
    r"|boa sorte\b|espero que (?:isto|isso|ajude)\b|(?:com os melhores )?cumprimentos\b|(?:um )?abraço\b|até (?:logo|breve|já)\b|diga-me\b|diz-me\b|avise-me\b|disponha\b)",
    re.I,
)
EMOTICON = re.compile(r"[:;=8xX][-o']?[)(DPpO\]}]$|[←-⯿\U0001f000-\U0001faff]️?$|<3$|\^\^$")
ABBREVIATION = re.compile(r"(?:^|[\s(])(?:nr|no|núm|nº|n\.º|bzw|z\.\s?b|ca|dr|prof|mr|mrs|ms|sr|sra|mme|st|etw|evtl|e\.g|i\.e|p\.\s?ex|p\.\s?ej|vs|fig|approx)\.$", re.I)
FENCE = re.compile(r"```|^~~~", re.M)
ITEM = re.compile(r"^\s*(?:[-*+•‣◦–—→▪●○·>»#☐☑✓✔]|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)\]:]|\d{1,2}/)\s*\S")
CELLS = re.compile(r"\||\t|;\S|\S;|\s{3,}\S|^\s*(?:[\w.-]+,){2,}")

# Names of the languages in the languages.
NAMED = {
    "en": r"english|englisch\w*|inglés|inglesa?|anglaise?|inglês",
    "de": r"german|deutsch\w*|alemán|alemana?|allemande?|alemão|alemã",
    "es": r"spanish|spanisch\w*|español\w*|espagnole?|espanhol\w*|castellano",
    "fr": r"french|französisch\w*|francés|francesa?|française?|francês",
    "pt": r"portuguese|portugiesisch\w*|portugués|portuguesa?|portugaise?|português|brazilian",
}
ASKS = [re.compile(rf"\b(?:{NAMED[x]})\b", re.I) for x in stopwords.LANGUAGES]


class SuffixAutomaton:
    """Of a sequence of words: states for all its runs, with where each ends first."""

    def __init__(self, words: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for i, w in enumerate(words):
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            self.end.append(i)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    self.end.append(self.end[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def coverage(self, words: list[int], least: int) -> tuple[float, float]:
        """Share of the given words, and of the automaton's own, that lie in common runs of at least ``least`` words."""
        n = self.length[-1] if len(self.next) == 1 else max(self.end) + 1
        theirs, own = bytearray(len(words)), bytearray(max(n, 1))
        state = run = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                run += 1
            if run >= least:
                theirs[i - run + 1 : i + 1] = b"\x01" * run
                e = self.end[state]
                own[e - run + 1 : e + 1] = b"\x01" * run
        return sum(theirs) / max(1, len(words)), sum(own) / max(1, n)


def refuses(answer: str) -> bool:
    """Whether the answer only declines."""
    declined = False
    for s in SENTENCE.split(answer):
        if not (s := s.strip()):
            continue
        if REFUSAL.search(s):
            declined = True
        elif not COURTESY.search(s):
            return False
    return declined


def stops_short(answer: str, prose: bool) -> bool:
    """Whether the answer stops inside a code block, or inside a sentence or word of prose."""
    stack: list[str] = []
    for m in FENCE.findall(answer):
        if stack and stack[-1] == m:
            stack.pop()
        elif not stack:
            stack.append(m)
    if stack:
        return True
    lines = [x for x in answer.split("\n") if INVISIBLE.sub("", x)]
    last = lines[-1].strip().strip("​﻿ ")
    bare = last.rstrip("\"'”»’)]*_")
    if not bare or not prose:
        return False
    if bare[-1] in ".?!…`":
        return bool(ABBREVIATION.search(bare))
    if EMOTICON.search(last) or last.endswith(("```", "|", ">", "}", ";")):
        return False
    fragment = SENTENCE.split(last)[-1].strip()
    if SIGN_OFF.search(fragment):
        return False
    short = [len(x.split()) <= 8 and x.rstrip()[-1:] not in ".?!" for x in lines]
    if ITEM.search(last) or CELLS.search(last):
        return False
    # an entry of a list without marks
    return not (len(lines) >= 3 and sum(short[-4:]) >= min(3, len(lines)) and fragment == last)


def unworded(answer: str) -> bool:
    """Whether most lines are entries of a list or rows of cells, which have no language."""
    lines = [x for x in answer.split("\n") if x.strip()]
    bare = sum(bool(ITEM.search(x) or CELLS.search(x)) or (len(lines) > 2 and len(x.split()) <= 6 and x.rstrip()[-1:] not in ".?!") for x in lines)
    return 2 * bare > len(lines)


def defects(df: DataFrame) -> DataFrame:
    """(exchange_id, defect)."""
    tab = stopwords.table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                p = b.slice(lo, 1000)
                ids, found = [], []
                rows = []
                for i, rq, rs in zip(p["id"].to_pylist(), p["request_json"].to_pylist(), p["response_json"].to_pylist(), strict=True):
                    m, a = messages_of(rq), answer_of(rs)
                    if m is None or a is None:
                        continue
                    if not INVISIBLE.sub("", a):
                        ids.append(i)
                        found.append("empty")
                        continue
                    users = [c for role, c in m if role == "user"]
                    rows.append((i, a, users[-1] if users else "", users))
                for i, d in zip((r[0] for r in rows), _judge([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], tab), strict=True):
                    if d:
                        ids.append(i)
                        found.append(d)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], ["exchange_id", "defect"])

    rows = df.where("id is not null").select("id", "request_json", "response_json")
    # redelivered rows are equal, so each gives the same defect
    return rows.mapInArrow(run, "exchange_id string, defect string").distinct()


def _judge(answers: list[str], lasts: list[str], users: list[list[str]], tab: tuple[np.ndarray, np.ndarray]) -> list[str | None]:
    aw, ae = word_arrays(answers)
    uw, ue = word_arrays(lasts)
    n = len(answers)
    # words of the answer that the message has at all: an upper bound of the copied share
    owner = np.repeat(np.arange(n), np.diff(ae)).astype(np.uint64)
    have = np.sort(mix(uw ^ mix(np.repeat(np.arange(n), np.diff(ue)).astype(np.uint64))))
    key = mix(aw ^ mix(owner))
    inside = have[np.minimum(np.searchsorted(have, key), len(have) - 1)] == key if len(have) else np.zeros(len(key), bool)
    size = np.diff(ae)
    bound = np.bincount(owner.astype(np.int64), weights=inside, minlength=n) / np.maximum(size, 1)
    va, vu = stopwords.votes(aw, ae, tab), stopwords.votes(uw, ue, tab)
    out: list[str | None] = []
    for i, a in enumerate(answers):
        if refuses(a):
            out.append("refusal")
            continue
        if 0 < size[i] < 4 and np.array_equal(aw[ae[i] : ae[i + 1]], uw[ue[i] : ue[i + 1]]):  # too short for runs
            out.append("echo")
            continue
        if bound[i] >= COPIED_ANSWER and size[i] >= 4:
            theirs, own = SuffixAutomaton(uw[ue[i] : ue[i + 1]].tolist()).coverage(aw[ae[i] : ae[i + 1]].tolist(), RUN)
            if theirs >= COPIED_ANSWER and own >= COPIED_PROMPT:
                out.append("echo")
                continue
        v = vu[i]
        if v.sum() < 4 and len(users[i]) > 1:
            w, e = word_arrays([" ".join(users[i])])
            v = stopwords.votes(w, e, tab)[0]
        if v.sum() >= 3 and va[i].sum() >= 4:
            x, y = int(np.argmax(va[i])), int(np.argmax(v))
            if x != y and va[i][x] >= 0.6 * va[i].sum() and va[i][x] >= 2.5 * va[i][y] and v[y] >= 1.5 * v[x] and not any(ASKS[x].search(t) for t in users[i]) and not unworded(a):
                out.append("wrong_language")
                continue
        out.append("truncated" if stops_short(a, va[i].sum() >= 0.12 * size[i]) else None)
    return out
