"""Kernels against identities and dense solves."""

import numpy as np
import pytest

from quartermill.plans import linear, smoothing, statespace
from quartermill.plans.statespace import System

PAIR = System.of([[0.7, 0.1], [0.0, 0.5]], np.eye(2), np.diag([0.04, 0.09]), [[1.0, 0.0], [0.5, 1.0]], np.diag([0.01, 0.02]))


def test_scalar_likelihood_of_two_periods():
    """Start N(1, 2): y1 ~ N(1.5, 0.25 * 2 + 0.3 + 0.2), then the update by its gain."""
    m = System.of(0.5, 1.0, 0.3, 1.0, 0.2, C=[1.0])
    f = statespace.filtered(m, np.array([[2.1], [1.0]]), (np.array([1.0]), np.array([[2.0]])))
    s, p, total = 1.0, 2.0, 0.0
    for y in (2.1, 1.0):
        s, p = 0.5 * s + 1, 0.25 * p + 0.3
        total += -0.5 * (np.log(2 * np.pi * (p + 0.2)) + (y - s) ** 2 / (p + 0.2))
        s, p = s + p / (p + 0.2) * (y - s), p * 0.2 / (p + 0.2)
    assert f["total"] == pytest.approx(total) and f["state"][-1] == pytest.approx(s)


def test_missing_period_only_predicts():
    f = statespace.filtered(PAIR, np.full((2, 2), np.nan))
    assert np.allclose(f["state"], f["pred"]) and f["total"] == 0


def dense_posterior(m, y, s0, p0):
    """Mean of all states given y by stacking the Gaussian."""
    t, n = len(y), len(m.T)
    mean, blocks, s = [], np.zeros((t * n, t * n)), s0
    var = [None] * t
    p = p0
    for i in range(t):
        s, p = m.T @ s + m.C, m.T @ p @ m.T.T + m.R @ m.Q @ m.R.T
        mean.append(s)
        var[i] = p
    for i in range(t):
        for j in range(i, t):
            c = var[i] @ np.linalg.matrix_power(m.T, j - i).T
            blocks[i * n : (i + 1) * n, j * n : (j + 1) * n] = c
            blocks[j * n : (j + 1) * n, i * n : (i + 1) * n] = c.T
    z = np.kron(np.eye(t), m.Z)
    seen = ~np.isnan(y.ravel())
    z = z[seen]
    cov = z @ blocks @ z.T + np.kron(np.eye(t), m.E)[np.ix_(seen, seen)]
    gap = (y.ravel() - np.kron(np.eye(t), m.Z) @ np.concatenate(mean) - np.tile(m.D, t))[seen]
    return (np.concatenate(mean) + blocks @ z.T @ np.linalg.solve(cov, gap)).reshape(t, n)


def test_smoother_is_the_dense_posterior_with_gaps():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(8, 2))
    y[2, 0] = y[5] = np.nan
    start = (np.zeros(2), np.eye(2))
    states, cov = statespace.smoothed(PAIR, f := statespace.filtered(PAIR, y, start))
    assert np.allclose(states, dense_posterior(PAIR, y, *start), atol=1e-9)
    assert np.allclose(states[-1], f["state"][-1])
    assert all(np.trace(a) <= np.trace(b) + 1e-12 for a, b in zip(cov, f["cov"]))


def test_stationary_covariance():
    p = linear.stationary_covariance(PAIR.T, PAIR.Q)
    assert np.allclose(p, PAIR.T @ p @ PAIR.T.T + PAIR.Q)


def test_response_is_a_difference_of_forecasts():
    e = np.zeros((6, 2))
    base = statespace.simulated(PAIR, np.ones(2), e)
    e[0, 1] = 0.3
    moved = statespace.simulated(PAIR, np.ones(2), e)
    assert np.allclose((moved - base) @ PAIR.Z.T, statespace.responses(PAIR, 6)[:, :, 1])


def test_conditioning_hits_its_targets_with_the_smallest_shocks():
    want = np.full((5, 2), np.nan)
    want[3, 0], want[4, 1] = 1.0, -0.5
    e = statespace.conditioned(PAIR, np.zeros(2), want)
    y = statespace.simulated(PAIR, np.zeros(2), e) @ PAIR.Z.T
    assert np.allclose(y[[3, 4], [0, 1]], [1.0, -0.5])
    assert np.allclose(statespace.conditioned(PAIR, np.zeros(2), want, allowed=[0])[:, 1], 0)


def test_decomposition_adds_up():
    y = np.random.default_rng(1).normal(size=(9, 2))
    states, _ = statespace.smoothed(PAIR, statespace.filtered(PAIR, y))
    base, parts = statespace.decomposed(PAIR, states)
    assert np.allclose(base + parts.sum(axis=2), states @ PAIR.Z.T + PAIR.D)


@pytest.mark.parametrize("n", [3, 4, 5, 12, 60])
def test_trend_is_the_dense_solve(n):
    y = np.random.default_rng(n).normal(size=n).cumsum()
    d = np.diff(np.eye(n), 2, axis=0)
    assert np.allclose(smoothing.trend(y, 1600), np.linalg.solve(np.eye(n) + 1600 * d.T @ d, y))


def test_trend_and_missing_values():
    assert np.allclose(smoothing.trend(np.array([1.0, 2.0])), [1, 2])
    assert np.isnan(smoothing.trend(np.array([1.0, np.nan, 2.0, 3.0]))).all()
    assert np.isnan(smoothing.trend(np.array([np.nan, 1.0, 2.0, 4.0, np.nan]))[[0, -1]]).all()


def test_solution_of_a_forward_looking_pair():
    g0 = np.array([[1.0, -0.9, -1.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    g1 = np.array([[0.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.5]])
    t, r, c = linear.rational_expectations(g0, g1, np.zeros(3), np.array([[0.0], [0.0], [1.0]]), np.array([[0.0], [1.0], [0.0]]))
    assert r[0, 0] == pytest.approx(1 / 0.55) and t[2, 2] == pytest.approx(0.5)
    assert t[0, 2] == pytest.approx(0.5 / 0.55) and np.allclose(c, 0)


def test_no_stable_solution_and_too_many():
    # x(+1) = 2 x + e whose only free forecast error is another equation's, and x(+1) = x / 2 with one
    with pytest.raises(linear.NoStableSolution):
        linear.rational_expectations(np.eye(2), np.diag([2.0, 0.5]), np.zeros(2), np.array([[1.0], [0.0]]), np.array([[0.0], [1.0]]))
    with pytest.raises(linear.NoStableSolution):
        linear.rational_expectations(np.eye(1), np.array([[0.5]]), np.zeros(1), np.ones((1, 1)), np.ones((1, 1)))


def test_samples_do_not_depend_on_partitions(spark):
    f = lambda n: sorted(map(tuple, statespace.sampled_forecasts(spark, PAIR, np.zeros(2), 3, 20, 1, n).collect()))
    assert f(1) == f(5) and len({r[3] for r in f(1)}) == 120
