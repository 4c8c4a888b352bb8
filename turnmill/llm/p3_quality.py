"""Problem 3: text quality statistics of staged records, and their kind by a Gaussian mixture.

Statistics of the assistant turns are standardized and a mixture of Gaussians with diagonal covariance is fitted by expectation-maximization over all
records: each round is one pass over the table of statistics, of which a row of sums a task comes back. The components start at
inspected examples (EXAMPLES, written for this purpose) and, once the likelihood stands still, are mapped to prose, list, table or junk by the examples nearest to
them. The kind of a record is that of the components with most of its posterior. p3_found then holds it against the definition of this kind: more than half of the non-blank lines are
list entries or rows of cells; hardly any words are function words of a language. What fits another kind's definition only is not found.

Results: a row a record in ``statistics``; ``found`` gives (staged_id, kind). Records that don't parse, without turns or without an id have no row
in ``found``; records without words in assistant turns can be junk only if there is visible text. Stored signals that are null, empty or not an object don't count;
missing keys don't differ. Repeated ids give each row once. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm import stopwords
from turnmill.llm.texts import turns_of, word_spans
from turnmill.session import written

STATS = ("list_share", "table_share", "common_share", "symbol_ratio", "word_length", "ended_share", "line_words", "distinct_share")
#: EM ends when the mean log-likelihood of a record rises by less than TOLERANCE, or after ROUNDS.
ROUNDS, TOLERANCE = 40, 2e-3
COMMON_WORDS = 0.12
KINDS = ("prose", "list", "table", "junk")

ENTRY = re.compile(r"^\s*(?:[-*+•‣◦–—→▪●○·>☐☑✓✔]|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)\]:])\s+\S")
CELLS = re.compile(r"^\s*\|.*\||\w\s*\|\s*\w|\w\t\s*\w|\w;\w|\w\s{3,}\w|^\s*(?:[\w.-]+,){2,}[\w.-]+\s*$")
RULE = re.compile(r"^[\s|:+=-]{3,}$")
FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
CLOSED = re.compile(r"```.*?```", re.S)
SOLID = re.compile(r"[^\W_]")
PARTS = re.compile(r"\||\t|;|,(?! )|\s{3,}")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")

def is_cells(line: str) -> bool:
    """Whether a line is a row of cells: the marks are looked for before the expression is run."""
    return ("|" in line or "\t" in line or ";" in line or "   " in line or ("," in line and ", " not in line)) and bool(CELLS.search(line) or RULE.match(line))


def in_cells(line: str) -> bool:
    """Whether a row's cells are short, as they are in a table, and mostly letters and digits."""
    parts = [p for p in PARTS.split(line) if p.strip()]
    return bool(RULE.match(line)) or len(parts) >= 2 and all(len(p.split()) <= 4 for p in parts) and 2 * len(SOLID.findall(line)) >= sum(map(len, parts))


#: Inspected examples: kind and answer.
EXAMPLES = (
    ("prose", "You can start the server from the menu. After that it takes a minute until the page answers. If it does not, look at the log and try again."),
    ("prose", "Zuerst öffnet man die Datei mit dem Editor. Dann wird die Zeile geändert und alles gespeichert. Danach läuft das Programm wieder wie vorher."),
    ("prose", "Il faut d'abord ouvrir le fichier avec un éditeur. Ensuite on change la ligne et on enregistre. Le programme marche alors comme avant."),
    ("prose", "Primero hay que abrir el archivo con un editor. Luego se cambia la línea y se guarda todo.\nDespués el programa funciona como antes, si no hay otro error."),
    ("prose", "Try this and see what it prints.\n\n```python\nfor x in rows:\n    total += x.size\nprint(total)\n```\n\nThe sum should be the same as in the report."),
    ("prose", "There are three things that you need for this.\n- a knife\n- some oil\n- a pan\nPut the oil into the pan and wait until it is hot. Then cut the bread with the knife.\nIt is done when it is brown."),
    ("prose", "we opened the old file with another editor after lunch and changed the second line because the first one was still needed by the other team and then we saved it"),
    ("prose", "Wir haben die alte Datei nach dem Essen noch einmal geöffnet und die zweite Zeile geändert, weil die erste noch gebraucht wird. Danach haben wir sie gespeichert und allen"),
    ("list", "Here is what you need to take along when you walk up the hill tomorrow.\n- warm coat\n- dry socks\n- some bread\n- cold tea\n- small lamp\n- paper map\n- spare rope\n- old knife"),
    ("list", "Das brauchst du morgen auf dem Weg nach oben.\n1. warme Jacke\n2. trockene Socken\n3. etwas Brot\n4. kalter Tee\n5. kleine Lampe\n6. alte Karte\n7. neues Seil"),
    ("list", "Esto es lo que hay que llevar para subir mañana al monte.\n• ropa seca\n• pan duro\n• té frío\n• lámpara chica\n• mapa viejo\n• cuerda nueva"),
    ("list", "- warm bread\n- cold butter\n- two eggs\n- a pinch of salt\n- some milk"),
    ("list", "1. blue paint\n2. small brush\n3. old paper\n4. water\n5. a towel\n6. tape"),
    ("list", "old map\nrain coat\nwater bottle\ngood shoes\nsmall tent\nrope"),
    ("list", "a) first row\nb) second seat\nc) third floor\nd) last door"),
    ("table", "| name | size | price |\n|---|---|---|\n| bolt | 12 | 0.30 |\n| nut | 12 | 0.10 |\n| washer | 14 | 0.05 |"),
    ("table", "name,size,price\nbolt,12,0.30\nnut,12,0.10\nwasher,14,0.05"),
    ("table", "name\tsize\tprice\nbolt\t12\t0.30\nnut\t12\t0.10\nwasher\t14\t0.05"),
    ("table", "name      size    price\nbolt      12      0.30\nnut       12      0.10\nwasher    14      0.05"),
    ("junk", "f3a9c01b77 9e4d1 a0b1c2d3e4f5 77aa01 0f9e8d7c6b 4c5d e1f2a3b4"),
    ("junk", "{]=+[; }!~ #%^ &*|\\ <>/ _-= ;:{ }[ ]+= ~!# %^&* |<> /_-"),
    ("junk", "qwrtz plkjh mnbvc xsdfg hjklp wrtzp sdfgh zxcvb qwrtp lkjhg"),
    ("junk", '<div class="a1"></td><span id="b2"></div><li class="c3"></span><td></td>'),
    ("junk", "Ã¤Â¶ â€œÃŸ Â»Ã© ï¿½ Ã¼â€ Â§Ã¨ ï¿½ï¿½ Ã¶Â© â€¢Ã±"),
)


def measures(answers: list[str], tab: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The statistics, the number of words and whether there is visible text, a row an answer (assistant turns joined by a line end)."""
    n = len(answers)
    w, s, e, ends, _ = word_spans(answers)
    size = np.diff(ends)
    owner = np.repeat(np.arange(n), size)
    common = stopwords.votes(w, ends, tab).sum(1)
    length = np.bincount(owner, weights=e - s, minlength=n)
    k = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (w >> np.uint64(24)))
    distinct = np.bincount((k[np.concatenate(([True], k[1:] != k[:-1]))] >> np.uint64(40)).astype(np.int64), minlength=n) if len(k) else np.zeros(n)
    lines = np.zeros((n, 4))
    solid = np.zeros(n)
    for i, a in enumerate(answers):
        rest = FENCE.sub("", a) if "```" in a else a
        rows = [x for x in rest.split("\n") if x.strip()]
        code = sum(1 for x in a.split("\n") if x.strip()) - len(rows)
        entries = cells = ended = 0
        for x in rows:
            t = x.rstrip()
            words = len(t.split())
            if "<" in t and not SOLID.search(TAG.sub("", t)):
                continue  # left-over markup is neither
            if is_cells(t) and in_cells(t):
                cells += 1
            elif (ENTRY.match(t) and words <= 14) or (words <= 7 and t[-1] not in ".?!:,"):
                entries += 1
            ended += t[-1] in ".?!…"
        lines[i] = entries, cells if cells > 1 else 0, ended, max(1, len(rows) + max(0, code))
        solid[i] = len(a) - a.count(" ") - a.count("\n")
    total = lines[:, 3]
    return np.stack((lines[:, 0] / total, lines[:, 1] / total, common / np.maximum(size, 1), np.clip(1 - length / np.maximum(solid, 1), 0, 1), np.log1p(length / np.maximum(size, 1)), lines[:, 2] / total, np.log1p(size / total), distinct / np.maximum(size, 1), size, solid), 1)


class Mixture:
    """Gaussian mixture with diagonal covariance on standardized statistics."""

    FLOOR = 0.02

    def __init__(self, mean: np.ndarray, std: np.ndarray, examples: np.ndarray):
        self.mean, self.std = mean, np.maximum(std, 0.02)
        self.m = (examples - self.mean) / self.std
        self.v = np.full_like(self.m, 0.5)
        self.w = np.full(len(self.m), 1 / len(self.m))

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posterior of the components, the standardized statistics and the log-likelihood (but for a constant), a row a record."""
        z = (x - self.mean) / self.std
        like = -0.5 * (((z[:, None] - self.m) ** 2 / self.v).sum(2) + np.log(self.v).sum(1)) + np.log(self.w)
        top = like.max(1, keepdims=True)
        p = np.exp(like - top)
        total = p.sum(1, keepdims=True)
        return p / total, z, (top + np.log(total)).ravel()

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each component: posteriors, of which the statistics and their squares; in a last column, all the same, the log-likelihood and the number of records."""
        p, z, like = self.posterior(x)
        both = np.full((len(self.m), 2), (like.sum(), len(x)))
        return np.concatenate((p.sum(0)[:, None], p.T @ z, p.T @ z**2, both), 1)

    def update(self, s: np.ndarray) -> None:
        d = self.m.shape[1]
        n = s[:, :1] + 1e-9
        # a component that answers for few records keeps near where it is (one record's worth of prior)
        self.v = np.maximum((s[:, 1 + d : 1 + 2 * d] + self.v + self.m**2) / (n + 1) - ((s[:, 1 : 1 + d] + self.m) / (n + 1)) ** 2, self.FLOOR)
        self.m = (s[:, 1 : 1 + d] + self.m) / (n + 1)
        self.w = (s[:, 0] + 1) / (s[:, 0] + 1).sum()


def statistics(staged: DataFrame) -> DataFrame:
    """(staged_id, the statistics, words, solid, stale, posteriors of the kinds), a row a record that parses."""
    tab = stopwords.table()
    schema = "staged_id string, " + ", ".join(f"{s} double" for s in STATS) + ", words long, solid long, stale boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                p = b.slice(lo, 1000)
                ids, answers, stale = [], [], []
                for i, t, q in zip(p["id"].to_pylist(), p["scrubbed_turns"].to_pylist(), p["quality_signals"].to_pylist(), strict=True):
                    if (turns := turns_of(t)) is not None:
                        ids.append(i)
                        answers.append("\n".join(c for role, c in turns if role == "assistant"))
                        stale.append(is_stale(q, turns))
                m = measures(answers, tab) if answers else np.zeros((0, len(STATS) + 2))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *(pa.array(m[:, i]) for i in range(len(STATS))), pa.array(m[:, -2].astype(np.int64)), pa.array(m[:, -1].astype(np.int64)), pa.array(stale, pa.bool_())], ["staged_id", *STATS, "words", "solid", "stale"])

    table = written(staged.where("id is not null").select("id", "scrubbed_turns", "quality_signals").mapInArrow(run, schema), "statistics")
    mixture, kinds = fitted(table)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, _, _ = mixture.posterior(np.stack([b[s].to_numpy() for s in STATS], 1))
            yield pa.RecordBatch.from_arrays([*(b[i] for i in range(b.num_columns)), *(pa.array(p[:, kinds == k].sum(1)) for k in range(len(KINDS)))], [*b.schema.names, *(f"p_{k}" for k in KINDS)])

    return table.mapInArrow(judge, schema + "".join(f", p_{k} double" for k in KINDS))


def fitted(table: DataFrame) -> tuple[Mixture, np.ndarray]:
    """The mixture after EM over all rows, and the kind of each component."""
    moments = table.select(*(F.avg(s).alias(s) for s in STATS), *(F.stddev_pop(s).alias(f"sd_{s}") for s in STATS)).first()
    x = measures([t for _, t in EXAMPLES], stopwords.table())[:, : len(STATS)]
    labels = np.array([KINDS.index(k) for k, _ in EXAMPLES])
    if moments[STATS[0]] is None:
        return Mixture(x.mean(0), x.std(0), x), labels
    mixture = Mixture(np.array([moments[s] for s in STATS]), np.array([moments[f"sd_{s}"] for s in STATS]), x)
    before = -np.inf
    for _ in range(ROUNDS):

        def sums(batches: Iterator[pa.RecordBatch], mixture: Mixture = mixture) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(x), 3 + 2 * len(STATS)))
            for b in batches:
                total += mixture.sums(np.stack([b[s].to_numpy() for s in STATS], 1))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

        # a row a task
        s = sum(np.frombuffer(bytes(r["s"])).reshape(len(x), -1) for r in table.select(*STATS).mapInArrow(sums, "s binary").toLocalIterator())
        mixture.update(s)
        now = s[0, -2] / s[0, -1]
        if now - before < TOLERANCE:
            break
        before = now
    return mixture, mapped(mixture, x, labels)


def mapped(mixture: Mixture, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The kind of each component: that of the inspected example nearest to its mean."""
    apart = (((x - mixture.mean) / mixture.std)[None] - mixture.m[:, None]) ** 2
    return labels[apart.sum(2).argmin(1)]


def is_stale(signals: str | None, turns: list[tuple[str | None, str]]) -> bool:
    """Whether the stored signals differ from what the turns give."""
    try:
        q = json.loads(signals) if signals else None
    except (ValueError, RecursionError):
        return False
    if not isinstance(q, dict) or not q:
        return False
    answers = [len(c) for role, c in turns if role == "assistant"]
    true = {"total_length": sum(len(c) for _, c in turns), "user_msg_count": sum(role == "user" for role, _ in turns), "assistant_msg_count": len(answers), "has_code": bool(CLOSED.search(" ".join(c for _, c in turns)))}
    if any(k in q and q[k] != v for k, v in true.items()):
        return True
    avg = q.get("avg_response_len", None)
    return isinstance(avg, (int, float)) and abs(avg - (sum(answers) / len(answers) if answers else 0)) > 1


def found(staged: DataFrame) -> DataFrame:
    s = statistics(staged)
    # the mixture says the kind, the definition of this kind confirms it
    likely = F.array_max(F.array(*(F.struct(F.col(f"p_{k}").alias("p"), F.lit(k).alias("kind")) for k in KINDS)))["kind"]
    holds = {"list": F.col("list_share") > 0.5, "table": F.col("table_share") > 0.5, "junk": (F.col("common_share") < COMMON_WORDS) & (F.col("list_share") + F.col("table_share") <= 0.5) & (F.col("solid") > 0)}
    kind = F.coalesce(*(F.when((F.col("likely") == k) & ok, k) for k, ok in holds.items()))
    kinds = F.array_compact(F.array(kind, F.when(F.col("stale"), "signals")))
    return s.withColumn("likely", likely).select("staged_id", F.explode(kinds).alias("kind")).distinct()
