"""No later passage is left out."""

import numpy as np

from skein.llm import toxicity


def test_repeated_passages_count_alike():
    model = toxicity.Model(odds={"insult$": 6.0, "slur$": 5.0}, rate=1.0, log_k=0.0)
    words = (["plain"] * 60 + ["insult", "slur"]) * 12
    found, _ = toxicity.passages_of(words, toxicity._Scores(model))
    real = [(a, b) for a, b, s in found if model.excess(s, len(words)) > -np.log(model.significant)]
    assert real == [(62 * k + 60, 62 * k + 62) for k in range(12)]
    joined, damped = toxicity.passages_of(["insult", "plain"] * 30, toxicity._Scores(model))
    assert [(a, b) for a, b, _ in joined] == [(0, 59)] and joined[0][2] >= 5.5 and damped[2] == 2.75  # damped within, found whole
