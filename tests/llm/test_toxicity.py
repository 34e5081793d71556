"""Marginals of whole texts: blocks make no difference; places of words in texts that lower-casing makes longer."""

import numpy as np

from tidegauge.llm import toxicity


def field(rng):
    words = {f"w{i}": float(rng.normal(0, 3)) for i in range(40)}
    return toxicity.Field(words, -0.5, rng.normal(size=(2, 2)), rng.normal(size=2)), list(words)


def whole(f, doc):
    """All words as one row."""
    e = np.array([[f.emission(w) for w in doc]])
    return toxicity.forward_backward(e, np.ones(e.shape, bool), f.transitions, f.start)[0][0]


def test_blocks_make_no_difference():
    rng = np.random.default_rng(4)
    for _ in range(5):
        f, words = field(rng)
        docs = [list(rng.choice(words, n)) for n in (0, 1, 127, 128, 129, 256, 257, 1000, 0, 5, 4000)]
        for doc, p in zip(docs, f.marginals(docs), strict=True):
            assert len(p) == len(doc) and (not doc or np.allclose(p, whole(f, doc), atol=1e-9))


def test_extreme_weights_stay_finite():
    f = toxicity.Field({"a": 900.0, "b": -900.0}, 0.0, np.array([[3.0, -8.0], [-8.0, 3.0]]), np.zeros(2))
    docs = [["a"] * 300, ["b"] * 300, ["a", "b"] * 300, ["c"] * 1000]
    assert all(np.isfinite(p).all() for p in f.marginals(docs))


def test_places_are_those_of_the_text_itself():
    text = "İİ İdiot and ﬃ Straße IDIOT"
    words = toxicity.words_of(text)
    p = np.array([1.0 if w.endswith("diot") else 0.0 for w in words])
    assert [text[a:b] for a, b, _ in toxicity.offsets(text, p)] == ["İdiot", "IDIOT"]
