"""Language ID sees all of a text that has no spaces."""

import numpy as np
import random

from barloom.llm import langid


def unspaced(rng, letters, n):
    return "".join(rng.choices(letters, k=n))


def test_all_of_a_text_without_spaces_counts():
    rng = random.Random(1)
    a, b = "日月火水木金土山川田", "かきくけこさしすせそ"
    texts = [(unspaced(rng, x, 400), lang) for _ in range(20) for x, lang in ((a, "a"), (b, "b"))]
    p = langid.Predictor(langid.fit(texts))
    labels, scores = p.predict([unspaced(rng, a, 40) + unspaced(rng, b, 400), unspaced(rng, a, 400) + "x", "1" * 60 + unspaced(rng, b, 60), "1" * 90])
    assert labels == ["b", "a", "b", "und"]
    assert 0.8 < scores[0] < 0.97


def test_positions_are_bounded_and_lose_nothing():
    text = "short " + "ab" * 500 + " x"
    words = langid.words_of(text)
    assert max(map(len, words)) <= langid.LONGEST and "".join(words) == text.replace(" ", "")
    assert langid.words_of("a bc  d") == ["a", "bc", "d"]


def test_tables_give_the_channel_s_emissions():
    """Looked up for many words at once, also where a word has characters that the fit doesn't know."""
    rng = random.Random(3)
    texts = [(" ".join("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(200)), lang) for lang, letters in (("a", "abcdeéß"), ("b", "abfghñ")) for _ in range(30)]
    crf = langid.fit(texts)
    words = sorted({w for t, _ in texts for w in t.split()}) + ["日本語", "a", "x^y", "a$b", "ß", "😀b", "zzzz", "ab日"]
    assert np.allclose(langid.Emissions(crf.channels[0])(words), crf.channels[0].emissions(words))
