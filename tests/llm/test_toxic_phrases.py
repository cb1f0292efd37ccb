"""Toxic words in one fixed phrase, and phrases of ordinary words, are evidence."""

import random
import tracemalloc

import numpy as np

from folioflow.llm import toxicity
from folioflow.llm.toxicity import SHARED_BITS, ClassModel, Evidence, Shared


def test_fixed_phrases():
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("aro", "eli", "ino", "ora")]
    text = lambda: " ".join(rng.choice(words, 40))
    ordinary = [text() + " baro " + text() + " teli" for _ in range(50)]
    toxic = [f"{text()} you zxqv {text()}" for _ in range(25)] + [f"{text()} baro teli 88 {text()}" for _ in range(25)] + [text() + " wuwu"]
    evidence = Evidence(ClassModel(toxic), ClassModel(ordinary), Shared(np.zeros(1 << SHARED_BITS, np.float32)))
    plain, word, digits, once = evidence.of([text(), f"{text()} you zxqv", f"{text()} teli 88", f"{text()} wuwu"])[:, 1]
    assert min(word, digits) > plain + 1 and once > plain
    phrase, turned = evidence.of(["baro teli", "teli baro"])[:, 1]
    assert phrase > turned + 1
    assert np.isfinite(evidence.of(["y" * 50_000, "", "new words"])).all()


def test_pairs_of_words_are_held_as_numbers():
    # Tuples of words took several times the memory of a sample's other parts, in the driver.
    draw = random.Random(1)
    words = [f"w{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260)}" for i in range(2000)]
    texts = [" ".join(draw.choices(words, k=500)) for _ in range(400)]
    tracemalloc.start()
    try:
        model = ClassModel(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    pairs = {p for t in texts for p in zip(["", *t.split()], t.split())}
    assert len(model.orders[-1][0]) > 0.99 * len(pairs) and peak < 200 * len(pairs)


def test_new_pairs_of_known_words_are_not_spelled_again(monkeypatch):
    # Most pairs of words stand once: each batch spelled nearly all of its words again.
    draw = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    text = lambda: " ".join(draw.choices(words, k=400))
    models = ClassModel([text() + " zxqv" for _ in range(5)]), ClassModel([text() for _ in range(5)])
    shared = Shared(np.zeros(1 << SHARED_BITS, np.float32))
    evidence, texts = Evidence(*models, shared), [text() for _ in range(20)] + ["", "never\u2003seen, x_9 88"]
    evidence.of([" ".join(words)])
    spelled = []

    class Counted(toxicity.Letters):
        def __init__(self, some):
            spelled.extend(some)
            super().__init__(some)

    monkeypatch.setattr(toxicity, "Letters", Counted)
    together = evidence.of(texts)
    assert sorted(spelled) == sorted(["never", "seen", ",", "x", "_", "9", "88"])
    for kept in (1, 350):  # words are forgotten and come back
        few = Evidence(*models, shared, kept)
        assert np.allclose([few.of([t])[0] for t in texts], together, rtol=0, atol=1e-12)


def test_shared_counts_of_words_between_signs(spark):
    texts = ["Ab,ab ab.\u2003AB", "x_9\tx", None, ""]
    got = {r["place"]: r["n"] for r in toxicity.corpus_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    want: dict[int, int] = {}
    for w in [w for t in texts for w in toxicity.words_of(t or "")]:
        for place in Shared.places(toxicity.Letters([w])):
            for p in place.tolist():
                want[p] = want.get(p, 0) + 1
    assert got == want
