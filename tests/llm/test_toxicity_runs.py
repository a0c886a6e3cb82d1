import random

import numpy as np
import pytest

from tesserae.llm import toxicity as T


@pytest.mark.parametrize("run", ["漢字かな交じり文" * 60, "ภาษาไทยที่ไม่มีช่องว่าง" * 30, "x" * 500, "é" * 300])
def test_every_gram_of_a_run_reaches_a_word(run):
    data = run.encode()
    words = T.words_of(data)
    assert all(w.decode() and len(w) <= T.LONGEST for w in words)
    for n in T.GRAM_SIZES:
        assert {data[i : i + n] for i in range(len(data) - n + 1)} == {w[i : i + n] for w in words for i in range(len(w) - n + 1)}
    assert len(T.cut([np.arange(1, len(words) + 1)])[0]) >= len(data) // T.LONGEST // T.WINDOW


def test_signs_and_spaces_of_other_scripts_divide_a_run():
    text = "this run is long enough that it has to be cut into its own words"
    assert T.words_of(text.replace(" ", "\u00a0").encode()) == text.encode().split()
    assert T.words_of(text.replace(" ", "\u2014").encode())[::2] == text.encode().split()
    for odd in (b"\x80" * 99, "\U0001f4a9".encode() * 20):
        assert max(map(len, T.words_of(odd))) <= T.LONGEST and sum(map(len, T.words_of(odd))) >= len(odd)


def test_a_toxic_passage_late_in_a_run_is_found():
    rng = random.Random(4)
    clean, bad = ([f"{k}{rng.randrange(10**6)}" for _ in range(40)] for k in ("fine", "vile"))
    texts = [" ".join(rng.choice(bad if i % 2 and 20 < j < 26 else clean) for j in range(40)) for i in range(120)]
    scorer = T.Scorer(T.train([t.encode() for t in texts], np.arange(120) % 2))
    late = [rng.choice(clean) for _ in range(300)]
    for gap in (" ", "\u00a0", "\u2014"):
        low, high = scorer.scores([gap.join(w).encode() for w in (late, [*late, *bad[:5]])])
        assert low < 0.5 < T.REJECT < high
