"""Problems 3 to 7."""

import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import staged, turns
from turnmill.llm import p3_quality, p4_language, p5_pii, p6_toxic, p7_pairs, stopwords, texts

SENTENCES = {
    "en": ["The {a} of the house is not as old as the garden.", "You can put the {a} on the table when you are back.", "There was a {a} in the box that we had not seen before.", "It is better to ask for the {a} before they close."],
    "de": ["Das {a} steht neben dem Haus und ist nicht sehr alt.", "Wir haben den {a} auf den Tisch gelegt, weil er voll war.", "Man kann das {a} auch ohne die anderen Teile benutzen.", "Es war nicht möglich, den {a} vor dem Abend zu öffnen."],
    "es": ["El {a} de la casa no es tan viejo como el jardín.", "Puedes poner el {a} sobre la mesa cuando vuelvas.", "Había un {a} en la caja que no habíamos visto antes.", "Es mejor preguntar por el {a} antes de que cierren."],
    "fr": ["Le {a} de la maison n'est pas aussi vieux que le jardin.", "Vous pouvez mettre le {a} sur la table quand vous rentrez.", "Il y avait un {a} dans la boîte que nous n'avions pas vu.", "Il vaut mieux demander le {a} avant qu'ils ne ferment."],
    "pt": ["O {a} da casa não é tão velho como o jardim.", "Você pode pôr o {a} sobre a mesa quando voltar.", "Havia um {a} na caixa que não tínhamos visto antes.", "É melhor perguntar pelo {a} antes que eles fechem."],
}
NOUNS = "motor radio piano tractor panel film sensor plan cable robot".split()


def prose(rng, lang, n=4):
    return " ".join(rng.choice(SENTENCES[lang]).format(a=rng.choice(NOUNS)) for _ in range(n))


# ---------------------------------------------------------------- 3


def test_kinds_and_signals(spark):
    rng = random.Random(1)
    rows, want = [], set()

    def put(i, answer, kind=None, signals="{}"):
        rows.append({"id": i, "scrubbed_turns": turns("What do you think about it?", answer), "quality_signals": signals})
        if kind:
            want.add((i, kind))

    for k in range(120):
        put(f"p{k}", prose(rng, rng.choice(list(SENTENCES)), rng.randrange(2, 9)))
    for k in range(8):
        put(f"l{k}", "\n".join(f"{rng.choice(['-', '*', '1.'])} {rng.choice(NOUNS)} {rng.choice(NOUNS)}" for _ in range(rng.randrange(5, 12))), "list")
        put(f"t{k}", "\n".join("| " + " | ".join(rng.choice(NOUNS) for _ in range(4)) + " |" for _ in range(rng.randrange(4, 9))), "table")
        put(f"j{k}", " ".join("%x" % rng.getrandbits(40) for _ in range(rng.randrange(12, 40))), "junk")
    put("code", "Try it like this and see.\n```py\nx = 1\ny = 2\nz = 3\n```\nThen it works as you said.")
    put("short", prose(rng, "en") + "\n- one\n- two\n" + prose(rng, "en") + "\n" + prose(rng, "en"))
    ok = p3_quality.is_stale
    t = texts.turns_of(turns("hi", "a ``` b ```", "x", "yes"))
    true = {"total_length": 17, "user_msg_count": 2, "assistant_msg_count": 2, "has_code": True, "avg_response_len": 7}
    assert not ok(json.dumps(true), t) and not ok("{}", t) and not ok(None, t) and not ok("[1]", t) and not ok("{cut", t)
    for k, v in (("total_length", 1), ("user_msg_count", 1), ("assistant_msg_count", 1), ("has_code", False), ("avg_response_len", 9)):
        assert ok(json.dumps(true | {k: v}), t)
    assert not ok(json.dumps(true | {"avg_response_len": 8}), t)
    put("stale", prose(rng, "en"), "signals", json.dumps({"total_length": 1}))
    put("both", "- a\n- b\n- c\n- d\n- e", "list", json.dumps({"user_msg_count": 9}))
    want.add(("both", "signals"))
    rows += [{"id": "null", "scrubbed_turns": None}, {"id": None, "scrubbed_turns": turns("a", "- b\n- c\n- d")}, {"id": "cut", "scrubbed_turns": "["}, {"id": "blank", "scrubbed_turns": turns("a", "")}, rows[0]]
    got = [tuple(r) for r in p3_quality.found(staged(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert p3_quality.found(staged(spark, [])).count() == 0


# ---------------------------------------------------------------- 4


def test_the_mixture_decides_the_kind(spark, monkeypatch):
    """With components mapped to another kind, what fits the definitions is no longer found."""
    rows = [{"id": f"l{i}", "scrubbed_turns": turns("what do I need?", "\n".join(f"- {a} {b}" for a in ("old", "red", "dry") for b in ("map", "sock", "rope")[: 1 + i % 3]))} for i in range(9)]
    rows += [{"id": f"p{i}", "scrubbed_turns": turns("how?", "You can open the file with the editor. Then it is changed and saved again, and the page shows it after a while. " * (1 + i % 3))} for i in range(30)]
    df = staged(spark, rows)
    assert {r[0] for r in p3_quality.found(df).collect()} == {f"l{i}" for i in range(9)}
    monkeypatch.setattr(p3_quality, "mapped", lambda mixture, x, labels: np.zeros(len(mixture.m), int))
    assert p3_quality.found(df).count() == 0


def test_languages(spark):
    rng = random.Random(2)
    rows, want = [], set()
    langs = list(SENTENCES)
    for k in range(150):
        main, stated = langs[k % 5], rng.choice([None, "", "und", "x"]) if k % 10 == 0 else langs[k % 5]
        if stated == "x":
            stated = "unknown"
        if stated and k % 3 == 0:
            stated = stated.upper() + "_XX"
        parts = [prose(rng, main), prose(rng, main)]
        if k % 4 == 1:
            other = rng.choice([x for x in langs if x != main])
            parts[1] += " " + prose(rng, other, 1)
            want.add((f"s{k:03}", 1, other))
        if k % 10 == 0:
            want |= {(f"s{k:03}", 0, main), (f"s{k:03}", 1, main)}
        rows.append({"id": f"s{k:03}", "scrubbed_turns": turns(*parts), "language": stated})
    rows += [{"id": "code", "scrubbed_turns": turns("```\nel perro no es de la casa ni del jardín\n```", "- el gato de la casa\n- el perro"), "language": "en"}, {"id": "null", "scrubbed_turns": None, "language": "en"}, {"id": None, "scrubbed_turns": turns(prose(rng, "de")), "language": "en"}, {"id": "few", "scrubbed_turns": turns("Das ist gut."), "language": "en"}, rows[0]]
    got = [tuple(r) for r in p4_language.found(staged(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert p4_language.found(staged(spark, [])).count() == 0


def test_collapsed_weights_equal_the_kernel_expansion():
    rng = random.Random(3)
    s = [prose(rng, x, 1) for x in list(SENTENCES) * 20]
    y = np.array(list(range(5)) * 20)
    k = p4_language.fit(s, y)
    new = [prose(rng, x, 1) for x in list(SENTENCES) * 40]
    assert (k.scores(new)[0].argmax(1) == np.array(list(range(5)) * 40)).mean() > 0.97
    g, owner, _ = p4_language.grams(["Ab, ab!"])
    assert len(set(g.tolist())) == len(g) == len({"a", "b", " ", "ab", "b ", " a", "ab ", "b a", " ab"})


# ---------------------------------------------------------------- 5

NAMES = p5_pii.Names({"orvella", "rose", "mark", "tobren"}, {"holmbeck", "brånvik", "quorrel"})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail orla.b+x@site.example now.", [("email", "orla.b+x@site.example")]),
        ("mail orla at mail dot example now", [("email", "orla at mail dot example")]),
        ("mail orla (at) mail(dot)example.", [("email", "orla (at) mail(dot)example")]),
        ("mail orla[at]mail.example, ok", [("email", "orla[at]mail.example")]),
        ("look at 22 percent, or dot the i", []),
        ("call (336) 555-0176 or +1 (753) 555-0189", [("phone", "(336) 555-0176"), ("phone", "+1 (753) 555-0189")]),
        ("tel ０３０/２３１２５-５５０ today", [("phone", "０３０/２３１２５-５５０")]),
        ("dial 01.99.00.60.29 or 07700 900122", [("phone", "01.99.00.60.29"), ("phone", "07700 900122")]),
        ("call five five five zero one two three four six nine please", [("phone", "five five five zero one two three four six nine")]),
        ("Order 4471-0681, serial 1056-919-34, build 2.56.36.44, row id 931271298, 2025-07-17", []),
        ("id 666-15-6865, ZZ 83 86 29 Q and 67.750.915-Z", [("id_number", "666-15-6865"), ("id_number", "ZZ 83 86 29 Q"), ("id_number", "67.750.915-Z")]),
        ("My social security number is 666336099 and", [("id_number", "666336099")]),
        ("I live at 7607 Old Mirefield St. and", [("address", "7607 Old Mirefield St.")]),
        ("in die Vellmoorstraße 79 geliefert", [("address", "Vellmoorstraße 79")]),
        ("Vivo en Avenida de Wicksted 133 y", [("address", "Avenida de Wicksted 133")]),
        ("J'habite au 105 chemin de Lowgarth et", [("address", "105 chemin de Lowgarth")]),
        ("In 50 Road tests out of 39 the drive made a noise.", []),
        ("The complaint was filed by Orvella B. Holmbeck on", [("name", "Orvella B. Holmbeck")]),
        ("taken by Quorrel, Tobren as before", [("name", "Quorrel, Tobren")]),
        ("Mrs. Holmbeck from the second floor", [("name", "Holmbeck")]),
        ("ask Tobren Unseenname about", [("name", "Tobren Unseenname")]),
        ("MY NAME IS MARK BRÅNVIK AND I", [("name", "MARK BRÅNVIK")]),
        ("Rose bushes need water. Mark every row. In Holmbeck it rains", []),
        ("Hi, this is orvella b. holmbeck, again", [("name", "orvella b. holmbeck")]),
        ("a poem for Rose, who is nine", [("name", "Rose")]),
        ("[NAME_1] wrote to [EMAIL] from [ADDRESS]", []),
        ("Ho​lmbeck said so", [("name", "Ho​lmbeck")]),
        ("", []),
    ],
)
def test_personal_data(text, want):
    got = [(k, text[a:z]) for a, z, k in p5_pii.spans(text, NAMES)]
    assert got == want


def test_redaction_keeps_the_rest():
    t = "Orvella Holmbeck, orla@mail.example, and Orvella Holmbeck again at 12 Old Mill Road."
    assert p5_pii.redact(t, NAMES) == "[NAME_1], [EMAIL_1], and [NAME_1] again at [ADDRESS_1]."


def test_personal_data_of_tables(spark):
    ex = spark.createDataFrame([("e1", json.dumps({"messages": [{"role": "system", "content": "x"}, {"role": "user", "content": "I am Orvella Zzebra, ok"}]})), ("e1", json.dumps({"messages": [{"role": "system", "content": "x"}, {"role": "user", "content": "I am Orvella Zzebra, ok"}]})), ("cut", "{"), (None, None), ("p", json.dumps({"prompt": "a@b.example"}))], "id string, request_json string")
    st = staged(spark, [{"id": f"s{i}", "scrubbed_turns": turns(f"ask {g} Zzebra there")} for i, g in enumerate(["Orvella", "Tobren", "Corwick"])] + [{"id": "z", "scrubbed_turns": turns("the Zzebra of Mrs. Zzebra")}, {"id": "n", "scrubbed_turns": None}])
    sm = spark.createDataFrame([(1, "f", [("user", None), ("user", "c@d.example"), (None, "e@f.example")]), (2, None, None), (None, "f", [("user", "g@h.example")])], "line_no long, file_name string, messages array<struct<role:string,content:string>>")
    kn = spark.createDataFrame([("Orvella", "given"), ("Tobren", "given"), ("Corwick", "given"), (None, "given"), ("Holmbeck", "family")], "name string, kind string")
    got = {tuple(r) for r in p5_pii.found(ex, st, sm, kn).collect()}
    # Zzebra is learnt from three given names before it
    assert {("exchanges", "e1", 1, "name", "Orvella Zzebra"), ("exchanges", "p", 0, "email", "a@b.example"), ("sample_messages", "1", 1, "email", "c@d.example"), ("sample_messages", "1", 2, "email", "e@f.example"), ("staged", "s2", 0, "name", "Corwick Zzebra")} <= got
    assert len([r for r in got if r[1] == "z"]) == 1 and len(got) == 8
    none = [df.limit(0) for df in (ex, st, sm, kn)]
    assert p5_pii.found(*none).count() == 0


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize(("word", "want"), [("n4k3d", "naked"), ("v3rm1n", "vermin"), ("plaaaague", "plague"), ("x-rated", "xrated"), ("d'ici", "dici"), ("1234", "0"), ("a1b", "aib")])
def test_plain_words(word, want):
    assert p6_toxic.plain(word) == want


def test_sentences_undo_disguises():
    assert p6_toxic.sentences("You c l o w n, go! It is a*plague.\nPa​thetic") == [["you", "clown", "go"], ["it", "is", "a", "plague"], ["pathetic"]]


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    s, t = rng.normal(size=(1, 4, p6_toxic.STATES)), rng.normal(size=(p6_toxic.STATES, p6_toxic.STATES))
    p, pair, log_z = p6_toxic._forward_backward(s, np.ones((1, 4), bool), t)
    want, total, wp = np.zeros((4, p6_toxic.STATES)), 0.0, np.zeros_like(t)
    for path in itertools.product(range(p6_toxic.STATES), repeat=4):
        w = np.exp(sum(s[0, i, k] for i, k in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path)))
        total += w
        for i, k in enumerate(path):
            want[i, k] += w
        for a, b in itertools.pairwise(path):
            wp[a, b] += w
    assert np.allclose(p[0], want / total) and np.isclose(log_z[0], np.log(total)) and np.allclose(pair, wp / total)


def test_toxic_records(spark):
    rng = random.Random(5)
    bad = {"abuse": ["Shut up, you {w}, nobody asked what you think.", "Only a {w} like you would say such a thing."], "hate": ["All {g} are {w} and should be thrown out of town.", "We were better off before {g}, those {w}, came here."]}
    words = {"abuse": ["numbskull", "halfwit", "clown"], "hate": ["vermin", "filth", "leeches"]}
    rows, labels, truth = [], [], {}
    for i in range(400):
        text = prose(rng, "en", 5)
        kind = None
        if i % 5 == 0:
            kind = "abuse" if i % 10 == 0 else "hate"
            text += " " + rng.choice(bad[kind]).format(w=rng.choice(words[kind]), g=rng.choice(["Zorvians", "Marrowfolk"]))
        elif i % 5 == 1:
            text += " " + rng.choice(["Rats are vermin in the barn, so what can we do?", "A clown costume for a party should be easy to sew."])
        truth[f"s{i:03}"] = kind
        rows.append({"id": f"s{i:03}", "scrubbed_turns": turns("Tell me about it.", text), "exchange_id": f"e{i}"})
        if i < 250:
            labels.append((i, f"s{i:03}", int(kind is not None), kind))
    labels += [(900, "s001", None, None), (901, None, 1, "abuse"), (902, "s005", 1, None), (903, "gone", 1, "abuse")]
    lab = spark.createDataFrame(labels, "label_id long, staged_id string, toxic int, category string")
    terms = spark.createDataFrame([(1, "clown", "abuse", 0.5), (2, None, "hate", 0.5), (3, "vermin", "hate", 0.9)], "term_id long, term string, category string, weight double")
    df = staged(spark, rows + [{"id": "null", "scrubbed_turns": None}, {"id": None, "scrubbed_turns": turns("x")}, rows[0]])
    got = {(r[0], r[1]) for r in p6_toxic.found(df, lab, terms).collect()}
    want = {(k, v) for k, v in truth.items() if v}
    held = {x for x in want if x[0] >= "s250"}
    assert len(got & held) / len(held) > 0.9 and len(got - want) <= 2
    assert p6_toxic.scores(df, lab, terms).where("size(spans) > 0").count() >= len(got)
    assert p6_toxic.found(df, lab.limit(0), terms).count() == 0 and p6_toxic.found(staged(spark, []), lab, terms).count() == 0
    ex = spark.createDataFrame([(f"e{i}", "one" if i % 2 else None) for i in range(400)], "id string, session_id string")
    ses = spark.createDataFrame([("one", "zip", "x")], "session_id string, source string, client string")
    assert {r["source"]: r["records"] for r in p6_toxic.rates(staged(spark, rows), ex, ses, lab, terms).collect()} == {"zip": 200, None: 200}


# ---------------------------------------------------------------- 7


def judge(ask, answer, users=None):
    a = p7_pairs.INVISIBLE.sub("", answer)
    return "empty" if not a else p7_pairs._judge([answer], [ask], [users or [ask]], stopwords.table())[0]


ASK = "How do I move the piano to the garden when the door of the house is not open? We have only two hours for it."
ANSWER = "You can ask the people next door for help with it. Then the window of the kitchen is the best way out."


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (ANSWER, None),
        ("​ \n\xa0", "empty"),
        (ANSWER[:-25], "truncated"),
        (ANSWER + " First take the,", "truncated"),
        (ANSWER + "\n```py\nx = 1\nfor", "truncated"),
        (ANSWER + "\n```py\nx = 1\n```", None),
        (ANSWER + " Hope this helps", None),
        (ANSWER + " Good luck with it :)", None),
        ("- piano\n- rope\n- two friends", None),
        ("| a | b |\n|---|---|\n| c | d |", None),
        ("f3a9c01b77 9e4d1 a0b1c2d3e4f5 77aa01 0f9e8d7c6b", None),
        ("I'm sorry, but I can't help with that request. Feel free to ask me something else.", "refusal"),
        ("Es tut mir leid, aber dabei kann ich Ihnen nicht helfen.", "refusal"),
        ("I can't open links from here, but the steps below should do. " + ANSWER, None),
        (ASK, "echo"),
        ('You asked me: "' + ASK.lower() + '"', "echo"),
        (ASK.replace("I", "you").replace("We", "You"), "echo"),
        ("Man kann die Leute von nebenan um Hilfe bitten, und dann ist das Fenster der Küche der beste Weg nach draußen.", "wrong_language"),
    ],
)
def test_defects(answer, want):
    assert judge(ASK, answer) == want


def test_language_that_was_asked_for():
    a = "Man kann die Leute von nebenan um Hilfe bitten, und dann ist das Fenster der Küche der beste Weg nach draußen."
    assert judge("Please say it in German. " + ASK, a) is None
    assert judge(ASK, a, ["Answer in German only, please.", ASK]) is None


def test_suffix_automaton_equals_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        p, a = ([rng.randrange(4) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        cov = [False] * len(a)
        for i in range(len(a)):
            for j in range(i + 3, len(a) + 1):
                if any(p[k : k + j - i] == a[i:j] for k in range(len(p))):
                    cov[i:j] = [True] * (j - i)
        assert abs(p7_pairs.SuffixAutomaton(p).coverage(a, 3)[0] - sum(cov) / max(1, len(a))) < 1e-9


def test_defects_of_a_table(spark):
    req = json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": ASK}]})
    rows = [("a", req, json.dumps({"choices": [{"message": {"content": ""}}]})), ("a", req, json.dumps({"choices": [{"message": {"content": ""}}]})), ("b", req, json.dumps({"message": {"content": ASK}})), ("c", req, "data: {}"), ("d", req[:-4], json.dumps({"response": ""})), ("e", json.dumps({"prompt": ASK}), json.dumps({"response": ANSWER})), (None, req, json.dumps({"response": ""})), ("f", None, None), ("g", req, json.dumps({"choices": []}))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, request_json string, response_json string, defect string")
    assert sorted(map(tuple, p7_pairs.defects(df).collect())) == [("a", "empty"), ("b", "echo"), ("g", "empty")]
    assert p7_pairs.defects(df.limit(0)).count() == 0


def test_long_refusals_and_short_echoes():
    long = "I'm sorry, but I can't help with that. " * 20
    answers, asked = [long, "Guten Morgen", "Guten Morgen"], ["How do I do it?", "Guten Morgen!", "Guten Abend"]
    assert p7_pairs._judge(answers, asked, [[x] for x in asked], stopwords.table())[:2] == ["refusal", "echo"]
    assert p7_pairs._judge(answers, asked, [[x] for x in asked], stopwords.table())[2] != "echo"


def test_whole_sentences_have_marginals():
    """A field whose runs span whole sentences: ways in and out are unlikely."""
    emit, trans = np.zeros(((1 << p6_toxic.BITS) + 1, p6_toxic.STATES)), np.zeros((p6_toxic.STATES, p6_toxic.STATES))
    emit[-1, 1] = 2
    trans[0, 1] = trans[1, 0] = -6
    trans[1, 1] = 3
    m, _ = p6_toxic.Field(emit, trans).marginals([["word"]])
    assert abs(m[0, 0] - np.exp(2) / (np.exp(2) + 3)) < 1e-5


def test_gates_lose_no_personal_data(monkeypatch):
    """Gated and ungated detection agree."""
    cases = {
        "I live at 5 Elm Street": "5 Elm Street", "Komm in die Hauptstraße 7": "Hauptstraße 7", "Vivo en Calle Mayor 3": "Calle Mayor 3", "Vivo en Pza. Mayor 3": "Pza. Mayor 3", "Vivo en Pº Sagasta 4": "Pº Sagasta 4", "Vivo en Rúa Nova 5": "Rúa Nova 5",
        "Sozialversicherungsnummer: 65170839J003": "65170839J003", "my driver's license is D1234567": "D1234567", "ID number 123456789": "123456789", "citizen number 123456789": "123456789", "write to anna @ example.com now": "anna @ example.com",
    }
    names = p5_pii.Names({"anna"}, {"smith"})
    gated = {t: p5_pii.spans(t, names) for t in cases}
    for gate in ("_DIGIT_ANY", "_ID_HINT", "_ES_HINT", "_MAY_AT", "_FIVE", "_CAP_NUMBER"):
        monkeypatch.setattr(p5_pii, gate, re.compile(""))
    for t, v in cases.items():
        assert gated[t] == p5_pii.spans(t, names), t
        assert v in [t[a:z] for a, z, _ in gated[t]], t


def test_names_beyond_what_is_broadcast_give_the_same(spark, monkeypatch):
    say = lambda *c: json.dumps([{"role": "user", "content": x} for x in c])
    rows = [("a", say("Orla Zzebra wrote.", "I met Bram Zzebra and Ines Zzebra there.")), ("b", say("ask Jovan Pellard or pellard", "nothing here")), ("c", say("Zzebra's note, by O. Zzebra")), ("b", say("ask Jovan Pellard or pellard", "nothing here")), (None, say("Orla Zzebra")), ("d", None)]
    staged_ = spark.createDataFrame(rows, "id string, scrubbed_turns string")
    ex = spark.createDataFrame([("x", json.dumps({"prompt": "mail Bram Pellard"}))], "id string, request_json string")
    samples = spark.createDataFrame([(1, [{"role": "user", "content": "Orla Pellard"}, None])], "line_no long, messages array<struct<role:string,content:string>>")
    known = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate([("Orla", "given"), ("Bram", "given"), ("Ines", "given"), ("Pellard", "family"), (None, "given")])], "name_id long, name string, kind string")
    one = sorted(map(tuple, p5_pii.found(ex, staged_, samples, known).collect()))
    text = sorted(map(tuple, p5_pii.redacted(ex, staged_, samples, known).collect()))
    assert ("staged", "a", 0, "name", "Orla Zzebra") in one and len(text) == len(set(text)) == 7
    monkeypatch.setattr(p5_pii, "FEW_NAMES", 1)
    assert sorted(map(tuple, p5_pii.found(ex, staged_, samples, known).collect())) == one
    assert sorted(map(tuple, p5_pii.redacted(ex, staged_, samples, known).collect())) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abZ 4@$!|'’-.?\n*_(\u200b\u0430İß9é", max_size=40))
def test_places_of_words_are_those_of_the_sentences(text):
    a, b = p6_toxic.sentences(text), p6_toxic.located(text)
    assert [len(s) for s in a] == [len(s) for s in b]
    for words, spots in zip(a, b, strict=True):
        for w, (x, y) in zip(words, spots, strict=True):
            assert 0 <= x < y <= len(text)
            if text.isascii() and text[x:y].isalpha() and not re.search(r"(.)\1\1", text[x:y].lower()):
                assert w == text[x:y].lower()


def test_long_sentences_are_learnt_and_scored_whole():
    rng = random.Random(1)
    s = [f"w{rng.randrange(50)}" for _ in range(5000)]
    f = p6_toxic.Field(np.zeros(((1 << p6_toxic.BITS) + 1, p6_toxic.STATES)), np.zeros((p6_toxic.STATES, p6_toxic.STATES)))
    m, ends = f.marginals([s, ["a"], ["b", "c"]] * 3)
    assert len(m) == 3 * 5003 and np.allclose(m, 1 / p6_toxic.STATES, atol=1e-4)
    groups = list(p6_toxic._groups(np.array([1, 1, 2, 500, 90_000]), np.arange(5)))
    assert np.concatenate(groups).tolist() == list(range(5)) and groups[-1].tolist() == [4]


def test_scaled_passes_equal_those_of_logarithms():
    rng = np.random.default_rng(3)
    s = rng.normal(0, 8, (40, 30, p6_toxic.STATES))
    mask = np.arange(30) < rng.integers(1, 31, 40)[:, None]
    trans = rng.normal(0, 4, (p6_toxic.STATES, p6_toxic.STATES))
    assert np.allclose(p6_toxic._marginals(s, mask, trans)[mask], p6_toxic._forward_backward(s, mask, trans)[0][mask], atol=1e-9)


def test_chance_of_frequent_runs():
    assert p6_toxic._tail(3, 3, 0.1) == pytest.approx(1e-3) and p6_toxic._tail(150, 200, 0.7) == pytest.approx(0.0695, abs=2e-3)
    assert p6_toxic._tail(290, 300, 0.95) > 0.05 > p6_toxic._tail(290, 300, 0.5)


def test_sentences_of_few_spaces_and_segments_with_places(spark):
    t = "Bon.\n```\ncode here and there and so on\n```\nC'est l'heure d'y aller. The box was not on the table when we came back."
    assert [t[a:z] for a, z in p4_language.located(t)] == p4_language.pieces(t) and [x.rstrip(".") for x in p4_language.pieces(t)] == ["C'est l'heure d'y aller", "The box was not on the table when we came back"]
    rng = random.Random(5)
    rows = [{"id": f"{lang}{i}", "scrubbed_turns": turns(prose(rng, lang), prose(rng, lang)), "language": lang} for lang in SENTENCES for i in range(30)]
    rows.append({"id": "mixed", "scrubbed_turns": turns(prose(rng, "en", 3) + " " + prose(rng, "de", 1)), "language": "en"})
    seg = [r for r in p4_language.segments(staged(spark, rows)).collect() if r["staged_id"] == "mixed"]
    body = json.loads(rows[-1]["scrubbed_turns"])[0]["content"]
    de = next(r for r in seg if r["lang"] == "de")
    assert body[de["start"] : de["end"]] in body and de["start"] > 0 and de["end"] >= len(body) - 1
    d = {r["staged_id"]: r for r in p4_language.documents(staged(spark, rows)).collect()}
    assert d["mixed"]["mixed"] and d["mixed"]["lang"] == "en" and d["de0"]["lang"] == "de" and 0 < d["de0"]["confidence"] <= 1
