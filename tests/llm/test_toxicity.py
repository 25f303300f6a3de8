"""Disguises that the decoder has to see through, under a letter model of plain words."""

import collections
import itertools

import pyarrow as pa
import pytest

from terrazzo.llm import toxicity

PLAIN = "you are a idiot moron trash stupid loser worthless pathetic fat stone stop statue trace crash those loose the well good tree book all small letter apple happy coffee there i am"


@pytest.fixture(scope="module")
def costs():
    codes = toxicity._codes()
    x = codes[[ord(c) for c in f"\n\n{PLAIN}\n\n"]]
    grams = collections.Counter(int((a * toxicity.SIZE + b) * toxicity.SIZE + c) for a, b, c in zip(x, x[1:], x[2:]))
    return toxicity.letter_model(pa.table({"gram": list(grams), "n": list(grams.values())}))


@pytest.mark.parametrize(
    "text, word",
    [
        ("you are a m o r o n", "moron"), ("y o u i d i o t", "idiot"), ("y o u  i d i o t", "idiot"), ("so f a t", "fat"), ("a m o r o n", "moron"),
        ("well " + " ".join("youarealosermoronidiot" * 12) + " there", "moron"), ("f 4 t", "fat"), ("a s t u p i d  m o r o n", "stupid"),
    ],
)
def test_spaced(costs, text, word):
    assert word in toxicity.spaced_words(pa.array([text]), costs).get(0, [])


@pytest.mark.parametrize("word, plain", [("iiddiioott", "idiot"), ("stuupid", "stupid"), ("m" + "o" * 60 + "ron", "moron"), ("stuuupid", "stupid"), ("1d10t", "idiot")])
def test_stretched(costs, word, plain):
    assert plain in toxicity.restore_all(word, costs)


@pytest.mark.parametrize("word", ["good", "tree", "book", "small", "letter", "happy", "coffee"])
def test_true_doubles_stay(costs, word):
    assert word in toxicity.restore_all(word, costs)


def test_long_words_are_decoded_in_pieces(costs):
    """An insult inside a word of more than 40 signs is in a piece; ends overlap."""
    found = toxicity.restore_all("xq" * 21 + "." + "1d10t", costs)
    assert len(found) > 1 and any(w.endswith("idiot") for w in found)


@pytest.mark.parametrize("word", ["1d10t", "m.o.r.o.n", "$tuuup1d", "l0$er", "a(t8ha", "8!gg€r", "w0rthl3ss", "x|y"])
def test_decode_against_every_reading(costs, word):
    """Viterbi finds the cheapest of all readings of a lattice."""

    def cost(letters, own):
        a = b = 0
        total = own
        for c in letters:
            k = toxicity._AT.get(c, 0)
            total += costs[a, b, k]
            a, b = b, k
        return total + costs[a, b, 0]

    readings = [("".join(x for x, _ in way), sum(c for _, c in way)) for way in itertools.product(*toxicity.lattice(word))]
    best = min(cost(*r) for r in readings)
    found = toxicity.decode(word, costs)
    assert min(cost(letters, own) for letters, own in readings if letters == found) == pytest.approx(best)


@pytest.mark.parametrize("word", ["ãb0", "МОР0Н", "å1d10t", "ναι0"])
def test_letters_outside_the_alphabet_stay(costs, word):
    kept = [c for c in word.lower() if c.isalpha() and c not in toxicity._AT]
    assert kept and [c for c in toxicity.restore(word, costs) if c in kept] == kept
