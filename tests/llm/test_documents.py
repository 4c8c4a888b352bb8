"""Problems 8, 9 and 10."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import WORD
from turnmill.llm import p8_packing, p9_leaks, p10_repetition, texts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab Ä_1.\n٣中İ", max_size=30) | st.none(), max_size=6), st.integers(1, 40))
def test_words_are_those_of_the_definition(ts, at_once):
    w, s, e, ends, _ = texts.word_spans(ts, "\n", at_once)
    for i, t in enumerate(ts):
        t = (t or "").replace("İ", "I")
        spans = [m.span() for m in WORD.finditer(t)]
        assert list(zip(s[ends[i] : ends[i + 1]], e[ends[i] : ends[i + 1]], strict=True)) == spans
    assert len(ends) == len(ts) + 1


def repeated(text):
    w = WORD.findall((text or "").lower())
    seen, cov = set(), set()
    for i in range(len(w) - 4):
        k = tuple(w[i : i + 5])
        if k in seen:
            cov.update(range(i, i + 5))
        seen.add(k)
    return len(w), len(cov) / max(1, len(w))


def docs(spark, ts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ts)], "doc_id long, text string, pattern string, words int")


def test_repetition(spark):
    rng = random.Random(2)
    plain = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    ts = [plain(rng.randrange(0, 120)) + "." for _ in range(400)]
    for _ in range(60):
        s = plain(rng.randrange(6, 14)) + ". "
        ts.append(plain(rng.randrange(10, 60)) + ". " + s * rng.randrange(3, 12))
    ts += [None, "", "word " * 19, "word " * 20, "same line here again and\n" * 5000, " ".join(f"u{i}" for i in range(30_000))]
    want = {i for i, t in enumerate(ts) if (m := repeated(t))[0] >= 20 and m[1] >= 0.3}
    got = {r[0] for r in p10_repetition.found(docs(spark, ts)).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 40
    assert p10_repetition.found(docs(spark, [])).count() == 0
    r = p10_repetition.repetition(docs(spark, ts))
    assert r.count() == len(ts) and {"run_share", "posterior"} <= set(r.columns)


def test_posterior_overrules_a_single_rule():
    """Where the first rule alone says that a few documents repeat, the others' votes prevail."""
    votes = np.array([[0] * 6, [1] * 6, [1, 1, 2, 1, 1, 1], [1, 0, 0, 0, 0, 0], [0, 1, 1, 1, 1, 1]])
    post = p10_repetition.fit(votes, np.array([900.0, 50, 20, 8, 4]))
    assert post[3] < p10_repetition.CUT < 0.5 < post[1]
    assert post[4] > 0.5  # and five against the first one
    # taken out, the model would change what is found
    assert (votes[:, 0] == 1).tolist() != (post >= p10_repetition.CUT).tolist()


def test_em_learns_the_rules():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.15
    v = np.where(rng.random((4000, 6)) < 0.9, y[:, None], ~y[:, None]).astype(int)
    u, inv, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    assert ((p10_repetition.fit(u, n.astype(float))[inv.ravel()] > 0.5) == y).mean() > 0.9


def leaked(ds, items, k=12):
    g = {}
    for i, x in items:
        w = WORD.findall((x or "").lower())
        for j in range(len(w) - k + 1):
            g.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = set()
    for d, t in ds:
        w = WORD.findall((t or "").lower())
        for j in range(len(w) - k + 1):
            out |= {(d, i) for i in g.get(tuple(w[j : j + k]), ())}
    return out


@pytest.fixture(scope="module")
def eval_case():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "the", *(f"w{i}" for i in range(300))]) for _ in range(n))
    opening = text(14)
    items = [(i, opening + " " + text(30)) for i in range(5)] + [(i, text(40)) for i in range(5, 20)] + [(20, "short"), (21, None), (22, "")]
    ds = [(i, text(60)) for i in range(40)]
    for d in range(40, 80):
        w = items[rng.randrange(20)][1].split()
        k = rng.choice([10, 11, 12, 13, 25])
        s = rng.randrange(len(w) - k + 1)
        ds.append((d, text(20) + " " + ", ".join(w[s : s + k]).upper() + " " + text(20)))
    return items, ds + [(80, None), (81, ""), (82, "a " * 100_000)]


def test_leaks_equal_brute_force(spark, eval_case):
    items, ds = eval_case
    d = spark.createDataFrame([*ds, (None, items[0][1])], "doc_id long, text string")
    i = spark.createDataFrame([*items, items[0], (None, "x " * 20)], "item_id long, text string")
    got = [tuple(r) for r in p9_leaks.leaks(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == leaked(ds, items)
    assert p9_leaks.leaks(d.limit(0), i).count() == 0 and p9_leaks.leaks(d, i.limit(0)).count() == 0


def test_leaks_in_blocks(spark, eval_case, monkeypatch):
    items, ds = eval_case
    monkeypatch.setattr(p9_leaks, "BLOCK_WORDS", 60)
    d, i = spark.createDataFrame(ds, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in p9_leaks.leaks(d, i).collect()} == leaked(ds, items)


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 14), st.integers(0, 4))
def test_bands_give_the_edit_distance(seed, w, most):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (20, w)).astype(np.uint64)
    y = x.copy()
    for r in y:
        for _ in range(rng.integers(0, 4)):
            r[rng.integers(w) :] = np.roll(r[rng.integers(w) :], 1)[-1] if rng.random() < 0.3 else rng.integers(0, 3)
    assert p9_leaks.within(x, y, most).tolist() == [distance(a, b) <= most for a, b in zip(x.tolist(), y.tolist(), strict=True)]


@pytest.mark.parametrize(("window", "edits"), [(12, 1), (24, 2), (40, 4)])
def test_edited_windows_are_found(window, edits):
    """The fitted repetitions reach the recall on other windows and edits than those they were fitted on."""
    rng = random.Random(6)
    ts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(window)) for _ in range(400)]
    (it,) = p9_leaks.indexed(list(range(400)), ts, window, edits, 0, 4, 0.95)
    assert len(it.plans) < p9_leaks.MOST_REPEATS
    hit = n = 0
    for i, t in enumerate(ts):
        w = t.split()
        for _ in range(edits):
            j = rng.randrange(len(w))
            w[j : j + rng.randrange(2)] = ["new"] * rng.randrange(2)
        words, ends = texts.word_arrays(["before it " + " ".join(w) + " after it and on"])
        rows = words[p9_leaks._starts(ends, window)[0][:, None] + np.arange(window)]
        mine = it.words[it.starts[i] : it.starts[i] + window]
        if p9_leaks.within(rows, np.repeat(mine[None], len(rows), 0), edits).any():
            n += 1
            hit += i in it.search(words, ends)[1]
    assert n > 100 and hit / n >= 0.92


def test_item_sized_windows_on_the_tables():
    """Against brute force over all windows of the smallest tables."""
    pq = pytest.importorskip("pyarrow.parquet")
    folder = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(folder):
        pytest.skip("no test data")
    items, docs = (pq.read_table(f"{folder}/{n}.parquet").to_pydict() for n in ("eval_items", "documents"))
    rng = random.Random(3)
    planted = []
    for t in items["text"][:60]:
        w = WORD.findall(t.lower())
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "zz"
        planted.append("some words first " + " ".join(w) + " and some after")
    words, ends = texts.word_arrays(docs["text"] + planted)
    got, want = set(), set()
    for table in p9_leaks.indexed(items["item_id"], items["text"], None, 0, 0.1, 4, 0.95):
        got |= set(zip(*(x.tolist() for x in table.search(words, ends)), strict=True))
        starts, owner = p9_leaks._starts(ends, table.window)
        rows = words[starts[:, None] + np.arange(table.window)]
        for s, o in zip(table.starts.tolist(), table.owner.tolist(), strict=True):
            mine = table.words[s : s + table.window]
            c = np.flatnonzero((~np.isin(rows, mine)).sum(1) <= table.edits)
            want |= {(k, o) for k in owner[c[p9_leaks.within(rows[c], np.repeat(mine[None], len(c), 0), table.edits)]].tolist()}
    assert got <= want and len(got & want) >= 0.95 * len(want) and len(want) >= 60


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60), st.integers(100, 300))
def test_pack_keeps_capacity(sizes, capacity):
    c, _ = p8_packing.pack(np.array(sizes, np.int64), capacity)
    used = np.bincount(c, weights=sizes) if len(sizes) else np.zeros(1)
    assert len(c) == len(sizes) and used.max(initial=0) <= capacity
    # two containers of the same pack never fit into one
    full = np.sort(used[used > 0])
    assert len(full) < 2 or len(full) <= -(-2 * sum(sizes) // capacity) + 1


def test_packing(spark):
    rng = random.Random(8)
    ts = ["word " * rng.randrange(1, 400) for _ in range(300)] + [None, "", "long " * 20_000]
    d = spark.createDataFrame([*((i, t) for i, t in enumerate(ts)), (5, ts[5]), (None, "x y z")], "doc_id long, text string")
    packs = spark.createDataFrame([(1, 128, None), (2, 1024, "b"), (None, 5, "c"), (3, None, "d"), (4, 0, "e")], "pack_id long, capacity int, note string")
    rows = p8_packing.packing(d, packs).collect()
    enc = p8_packing.encoder(p8_packing.TOKENIZER)
    size = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(ts)}
    for pack, cap in ((1, 128), (2, 1024)):
        mine = [r for r in rows if r["pack_id"] == pack]
        used = {}
        for r in mine:
            used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
        assert max(used.values()) <= cap
        per = {}
        for r in mine:
            per.setdefault((r["doc_id"], r["copy"]), []).append((r["piece"], r["tokens"]))
        assert len(per) == len(ts) + 2
        for (doc, _), p in per.items():
            if doc is None:
                continue
            assert sum(n for _, n in p) == size[doc] and sorted(k for k, _ in p) == list(range(len(p)))
            assert len(p) == (1 if size[doc] <= cap else -(-size[doc] // cap))
        assert 1 - sum(used.values()) / (cap * len(used)) < 0.05
    assert {r["pack_id"] for r in rows} == {1, 2}
    assert p8_packing.packing(d.limit(0), packs).count() == 0
