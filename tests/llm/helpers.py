import json
import random
import re

WORD = re.compile(r"[^\W_]+")


def shingles(text, k=3):
    w = WORD.findall(text.lower())
    return (set() if len(w) < 20 else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}), len(w)


def likeness(a, b):
    x, y = shingles(a)[0], shingles(b)[0]
    return len(x & y) / len(x | y) if x and y else 0


def family(n, copies, seed=1, words=120, vocabulary=4000):
    """n texts, each with some edited and exact copies."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(30, words))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(copies + 1)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(2)] = [f"w{rng.randrange(vocabulary)}"] * rng.randrange(1, 3)
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def turns(*contents):
    return json.dumps([{"role": "user" if i % 2 == 0 else "assistant", "content": c} for i, c in enumerate(contents)])


STAGED = "id string, exchange_id string, batch_no int, scrubbed_turns string, language string, quality_signals string, tbl string, grp double, word string"


def staged(spark, rows):
    """rows: dicts; columns that the operators use inside (tbl, grp, word) are there as extra ones."""
    names = [c.split()[0] for c in STAGED.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], STAGED)
