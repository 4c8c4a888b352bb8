"""Function words of the five languages of the data, as fixed values, and votes by them."""

from __future__ import annotations

import numpy as np

from turnmill.llm.texts import word_arrays

LANGUAGES = ("en", "de", "es", "fr", "pt")

# Common function words of each language.
WORDS = {
    "en": "the a an and or but if of to in on at by for with from as is are was were be been it its this that these those there here you your i my me we our they their he she his her not no do does did done can could should would will shall must may might have has had what which who whom when where why how than then so such only also very more most some any each every all both before after while until because although unless into over under about between again once whatever whether",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn ob als wie zu zum zur im in an am auf aus bei mit von vom vor nach über unter durch für gegen ohne um ist sind war waren sein wird werden wurde hat haben hatte kann können muss müssen soll darf nicht kein keine keinen auch noch nur schon sehr mehr so dann da dort hier dass weil damit während bevor ich du er sie es wir ihr mich mir dich dir ihm ihn uns euch ihnen mein meine unser unsere dieser diese dieses jeder jede jedes man sich was wer wo warum wann bis seit immer alle selbst sobald falls",
    "es": "el la los las un una unos unas y o pero si de del a al en con por para sin sobre entre hasta desde según es son era ser está están fue ha han hay haya puede puedo debe que qué cómo cuándo dónde quién cuál porque pues como cuando donde mientras aunque no ni ya muy más menos también tampoco solo siempre nunca me te se nos le les lo mi tu su sus nuestro nuestra este esta esto ese esa eso todo toda todos todas otro otra luego después antes tras durante así",
    "fr": "le la les l un une des du de d et ou mais si à au aux en dans sur sous avec sans pour par entre vers chez est sont était être a ont avait peut peux doit que qu qui quoi où quand comment pourquoi parce car comme lorsque pendant avant après dès alors ne pas n plus moins très aussi non jamais toujours encore je j tu il elle on nous vous ils elles me te se s lui leur mon ma mes ton ta notre votre son sa ses ce cet cette ces c tout toute tous toutes y même seulement puis ensuite",
    "pt": "o a os as um uma uns umas e ou mas se de do da dos das em no na nos nas ao à aos às com por para sem sobre entre até desde pelo pela é são era ser está estão foi tem têm há pode posso deve que quê como quando onde quem qual porque pois enquanto embora não nem já muito mais menos também só apenas sempre nunca me te se nos lhe lhes meu minha teu seu sua nosso nossa este esta isto esse essa isso todo toda todos todas outro outra depois antes durante assim senão caso",
}


def table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes, and for each the languages it votes for: one vote, shared by the languages that have the word."""
    votes: dict[int, np.ndarray] = {}
    for i, lang in enumerate(LANGUAGES):
        # single letters come in bulk in junk
        for h in np.unique(word_arrays([" ".join(w for w in WORDS[lang].split() if len(w) > 1)])[0]):
            votes.setdefault(int(h), np.zeros(len(LANGUAGES)))[i] = 1
    keys = np.array(sorted(votes), np.uint64)
    v = np.array([votes[int(k)] for k in keys])
    return keys, v / v.sum(1, keepdims=True)


def votes(words: np.ndarray, ends: np.ndarray, tab: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Votes of the words of each text: a row a text, a column a language."""
    keys, v = tab
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    hit = keys[at] == words
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[hit]
    return np.stack([np.bincount(owner, weights=v[at[hit], i], minlength=len(ends) - 1) for i in range(len(LANGUAGES))], 1)
