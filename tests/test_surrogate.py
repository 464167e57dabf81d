"""Model-based proposals on planted surfaces."""

import numpy as np

from corelode.operators.surrogate import FIRST, Range, propose


def surface(u):
    return 3 * (u[0] - 0.23) ** 2 + (u[1] - 0.71) ** 2 + 0.5 * (u[2] - 0.4) ** 2 + 0.05 * np.sin(9 * u[0])


def found(seed, n=25):
    units, errors = [], []
    for _ in range(n):
        units.append(propose(units, errors, 3, seed))
        errors.append(surface(units[-1]))
    return errors


def test_proposals_beat_random_ones_on_a_planted_surface():
    wins = 0
    for seed in range(8):
        random = min(surface(u) for u in np.random.default_rng(seed).random((25, 3)))
        errors = found(seed)
        wins += min(errors) < random
        assert min(errors) < min(errors[:FIRST])
    assert wins >= 7


def test_proposals_repeat():
    assert found(3, 12) == found(3, 12)


def test_ranges_reach_their_ends():
    assert [Range(100, 1000, whole=True).at(u) for u in (0.0, 1.0)] == [100, 1000]
    assert Range(0.01, 0.3, log=True).at(0.5) == np.sqrt(0.003)
    assert [Range(0.0, 10.0, power=2.0).at(u) for u in (0.0, 0.5, 1.0)] == [0.0, 2.5, 10.0]
