"""Viterbi decoding against a search of every path through the lattice."""

import random

import numpy as np
import pytest

from tidewatt.llm import toxicity as tx

LETTERS = "abegilost"


def plain_costs(observed: str, model: np.ndarray) -> dict[str, float]:
    """The least cost of every spelling that any path through the lattice says."""
    least: dict[str, float] = {}

    def symbol(word: str, back: int) -> int:
        return 0 if len(word) < back else ord(word[-back]) - 96

    def go(i: int, said: str, cost: float) -> None:
        x, y, z = (symbol(said, k) for k in (3, 2, 1))
        if i == len(observed):
            total = cost - float(model[x, y, z, 0])
            least[said] = min(total, least.get(said, float("inf")))
            return
        c = observed[i]
        meant = {c: 0.0} if c.isalpha() else dict.fromkeys(tx.IMITATED.get(c, ""), tx.IMITATION)
        for letter, paid in meant.items():
            go(i + 1, said + letter, cost + paid - float(model[x, y, z, ord(letter) - 96]))
        if said and (c == said[-1] or said[-1] in tx.IMITATED.get(c, "")):
            go(i + 1, said, cost + tx.REPEAT)
        elif c in tx.SEPARATORS:
            go(i + 1, said, cost + tx.SEPARATION)
        elif not c.isalpha() and c not in tx.IMITATED:
            go(i + 1, said, cost + 4 * tx.IMITATION)

    go(0, "", 0.0)
    return least


@pytest.mark.parametrize("seed", range(4))
def test_no_path_is_cheaper_than_the_decoded_word(seed):
    rng = random.Random(seed)
    scores = np.random.default_rng(seed).normal(0, 2, (28, 28, 28, 28))
    model = (scores - np.log(np.exp(scores).sum(-1, keepdims=True))).astype(np.float32)
    for _ in range(150):
        word = "".join(rng.choice(LETTERS + LETTERS + "01345678@$!|-. _%") for _ in range(rng.randint(1, 8)))
        costs = plain_costs(word, model)
        assert costs[tx.decode(word, model)] == pytest.approx(min(costs.values()), abs=1e-5), word


def test_stars_stand_for_vowels_separators_and_repeats():
    model = np.zeros((28, 28, 28, 28), np.float32)
    for word in ("b*d", "b**d", "*", "a--b", "s$$", "%%"):
        costs = plain_costs(word, model)
        assert costs[tx.decode(word, model)] == pytest.approx(min(costs.values()))


def _english() -> np.ndarray:
    """A model of a few words, by the smoothing of the operator."""
    counts = np.zeros((28, 28, 28, 28))
    for word in "ass asset idiot moron worthless bold note great under until class pass mess less letter " .split() * 20:
        code = [0, 0, 0, *(ord(c) - 96 for c in word), 0]
        for at in range(3, len(code)):
            counts[tuple(code[at - 3 : at + 1])] += 1
    p = np.full(28, 1 / 28)
    for kept in (counts.sum((0, 1, 2)), counts.sum((0, 1)), counts.sum(0), counts):
        p = (kept + 2.0 * p) / (kept.sum(-1, keepdims=True) + 2.0)
    return np.log(p).astype(np.float32)


@pytest.mark.parametrize(
    ("text", "word"),
    [
        ("an @$$ here", "ass"), ("an (@$$) here", "ass"), ("an a$$$ here", "ass"), ("i  d  i  o  t", "idiot"),
        ("so i\td\ti\to\tt", "idiot"), ("m\no\nr\no\nn", "moron"), ("w o  r\tt h l e s s", "worthless"), ("*moron*", "moron"),
        ("mor*n", "moron"), ("|diot", "idiot"), ("$$", "ss"),
    ],
)
def test_every_disguise_reaches_the_decoder(text, word):
    assert word in tx.Reader(_english()).words(text)[0]


def test_punctuation_at_the_edges_is_no_letter():
    reader = tx.Reader(_english())
    words, restored = reader.words("**bold** (until) #note great!!! <under> 'class' --")
    assert words - {"**bold**"} == {"bold", "until", "note", "great", "under", "class"} and restored == {"**bold**": "bold"}
    assert reader.words("*** --- +---+ || * -")[0] <= {"i", "a"}
    assert "f***" in reader.words("oh f***, no")[0]


def test_a_long_token_is_decoded_in_time_that_grows_with_it():
    word = "m0r0n-1d10t." * 20_000
    assert tx.decode(word, _english()).startswith("moronidiotmoron")
    reader = tx.Reader(_english())
    reader.words(word)
    assert not reader.known
