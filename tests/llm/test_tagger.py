import itertools

import numpy as np

from riskframe.llm.tagger import Tagger


def drawn(labels=3, hidden=3):
    rng = np.random.default_rng(4)
    tagger = Tagger(5, labels, hidden=hidden)
    tagger.p = {k: v.astype(np.float64) + rng.normal(0, 0.6, v.shape) for k, v in tagger.p.items()}
    return tagger, rng.integers(0, 5, (7, 6)), rng.integers(0, labels, (7, 6))


def paths(tagger, x):
    """The score of every label sequence of one row, by enumeration."""
    e = tagger.emissions(x)[:, 0]
    every = itertools.product(range(tagger.labels), repeat=x.shape[1])
    return {p: sum(e[t, v] for t, v in enumerate(p)) + sum(tagger.p["E"][a, b] for a, b in itertools.pairwise(p)) for p in every}


def test_decoding_and_likelihood_against_enumeration():
    tagger, x, y = drawn()
    got = tagger.decode(x)
    total = 0.0
    for k in range(len(x)):
        scores = paths(tagger, x[k : k + 1])
        assert tuple(got[k]) == max(scores, key=scores.get)
        total += np.log(sum(np.exp(v) for v in scores.values())) - scores[tuple(y[k])]
    assert np.isclose(tagger._loss(x, y)[0], total / len(x))


def test_lstm_against_plain_recursion():
    tagger, x, _ = drawn()
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    k = tagger.hidden
    for d in "fb":
        h, c = np.zeros(k), np.zeros(k)
        got = tagger._run(x[:1])[:, "fb".index(d)]
        for t, seen in enumerate(x[0] if d == "f" else x[0, ::-1]):
            z = tagger.p[f"W{d}"][seen] + tagger.p[f"b{d}"] + h @ tagger.p[f"U{d}"]
            i, f, o = (sigmoid(z[n * k : (n + 1) * k]) for n in range(3))
            c = f * c + i * np.tanh(z[3 * k :])
            h = o * np.tanh(c)
            assert np.allclose(got[t, 0], h)
