"""Language ID's features of many words at once against their strings, one word after the other."""

import random
import sys
import zlib

import numpy as np
from conftest_words import languages

from assayflow.llm import language_id


def strings_of(word, lexicon):
    first, last = word[0] != "-", word[-1] != "-"
    w = "^" * first + word.strip("-") + "$" * last
    own = {"b"} | {w[i : i + k] for k in (2, 3) for i in range(len(w) - k + 1)} | ({"w" + word} if word in lexicon else set())
    return own | {x for k in (2, 3, 4) for x in ["p" + w[:k]] * first + ["s" + w[-k:]] * last}


def test_features_of_many_words():
    rng = random.Random(3)
    letters = "abcspwbéßªǆ̈漢字हि𐐨𝒜\U000323af\U000e01ef"  # of one to four bytes, with marks, and the letters that mark features
    runs = ["".join(rng.choice(letters if rng.random() < 0.5 else "spwx") for _ in range(rng.choice((1, 2, 3, 4, 5, 9, 24, 25, 60)))) for _ in range(3000)]
    words = list(dict.fromkeys(language_id.cut_runs([*runs, "asx", "sxx", "sxxx", "a", "ppp", "b"])))
    assert sum(w[0] == "-" for w in words) > 500
    lexicon = frozenset(words[::3])
    found = {}
    for places, rows in language_id.feature_rows(words, lexicon):
        assert len(rows) <= language_id.ROWS
        found |= {words[i]: [f for f in row if f < language_id.BUCKETS] for i, row in zip(places.tolist(), rows.tolist(), strict=True)}
    assert list(map(found.get, words)) == [[zlib.crc32(x.encode()) % language_id.BUCKETS for x in sorted(strings_of(w, lexicon))] for w in words]
    assert all(language_id.features(w, lexicon) == found[w] for w in words[:200])


def test_new_words_cost_few_calls():
    """Texts that bring new words all the time were labelled by some eighty Python calls for each of these."""
    rng = random.Random(5)
    model = language_id.fit([(lang, languages(rng, lang, 50).split()) for lang in ("aa", "bb") for _ in range(20)])
    words = list({"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 12))) for _ in range(20_000)})
    labeller, calls = language_id.Labeller(model), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        ids = labeller.ids(words)
    finally:
        sys.setprofile(None)
    assert calls < 8 * len(words)
    scores = [model.weights[[zlib.crc32(x.encode()) % language_id.BUCKETS for x in sorted(strings_of(w, model.lexicon))]].sum(axis=0) for w in words[:500]]
    assert np.array_equal(labeller.scores[ids[:500]], scores)
