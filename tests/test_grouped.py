"""Sequential helpers against exhaustive or textbook versions."""

import itertools

import numpy as np

from viaduct.operators import grouped as G


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    for _ in range(30):
        e, p = r.normal(size=7), r.uniform(0, 2, 7)
        value = lambda s: sum(x if k else -x for x, k in zip(e, s)) - sum(p[i] for i in range(1, 7) if s[i] != s[i - 1])  # noqa: B023, E731
        best = max(itertools.product([0, 1], repeat=7), key=value)
        assert abs(value(G.viterbi_path(e, p)) - value(best)) < 1e-9
    assert G.viterbi_path(np.array([]), np.array([])) == [] and G.viterbi_path(np.array([0.0]), np.array([1.0])) == [0]


def test_activity_steps():
    active = np.array([0] * 5 + [1] * 8 + [0] * 7 + [1] * 8)
    assert G.activity(active, 8, 0.9) == [(5, 13)] and G.activity(active, 8, 0.75) == [(5, 13), (18, 26)]
    assert G.activity(np.zeros(3), 8, 0.5) == []


def test_similarity_fit_recovers_the_transform():
    r = np.random.default_rng(1)
    a = r.normal(size=(20, 3))
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    scale, rotation, shift = G.similarity_fit(a, 2.5 * a @ q.T + [1, 2, 3])
    assert abs(scale - 2.5) < 1e-9 and np.allclose(rotation, q) and np.allclose(shift, [1, 2, 3])
