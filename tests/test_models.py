"""Solver, equations as data, likelihoods, optimisers and chains against closed forms and direct evaluation."""

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from quartermill.plans import equations, estimation, frictions, likelihood, schur, statespace
from quartermill.plans.equations import Model, Root
from quartermill.plans.statespace import System
from quartermill.queries.models import NOISY, series_posterior


def pencil(phi, rho, link=1.0, live=1.0):
    g0 = np.array([[phi, -1, -1], [1, 0, 0], [0, 0, live]])
    g1 = np.array([[0, 0, 0], [0, 1, 0], [0, 0, live * rho]], float)
    return g0, g1, np.zeros(3), np.array([[0], [0], [live]], float), np.array([[0], [link], [0]], float)


# Solver --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 6, 15, 40])
@pytest.mark.parametrize("kind", ["dense", "defective", "repeated", "zero"])
def test_triangular_forms_and_their_order(n, kind):
    rng = np.random.default_rng(n)
    m = {"dense": rng.normal(size=(n, n)), "defective": np.eye(n, k=1), "zero": np.zeros((n, n))}.get(kind)
    if m is None:
        v = rng.normal(size=(n, n))
        m = v @ np.diag(np.arange(n) % 2.0) @ np.linalg.inv(v)
    u, z = schur.triangular(m)
    size = max(1.0, np.abs(m).max())
    first = np.abs(np.diag(u)) < 0.7
    for _ in range(2):  # as found, then in order
        assert np.abs(z @ u @ z.conj().T - m).max() < 1e-8 * size and np.abs(np.tril(u, -1)).max(initial=0) < 1e-9 * size
        assert np.allclose(z.conj().T @ z, np.eye(n))
        marks = schur.swapped(u, z, first)
    assert marks.sum() == first.sum() and not (np.diff(marks.astype(int)) > 0).any()


def test_codes_of_existence_and_uniqueness():
    code = lambda *a: schur.solved(*pencil(*a), method="expectations").codes
    assert code(1.5, 0.5) == (1, 1) and code(0.9, 0.5) == (1, 0)  # a weak rule leaves inflation open
    assert code(1.5, 0.5, 0.0) == (0, 1) and code(0.9, 0.5, 0.0) == (1, 1)  # nothing can jump
    assert code(1.5, 0.5, 1.0, 0.0) == schur.COINCIDENT
    zero = np.zeros((1, 1))
    assert schur.solved(zero, zero, np.zeros(1), zero, np.zeros((1, 0))).codes == schur.COINCIDENT
    found = schur.solved(*pencil(1.5, 0.5))
    assert np.allclose(found.r[:, 0], [1, 0.5, 1]) and np.allclose(found.t[:, 2], [0.5, 0.25, 0.5]) and np.allclose(found.t[:, :2], 0)


def test_methods_and_shapes():
    free = (2 * np.eye(2), np.array([[0.5, 0.2], [0.0, 0.4]]), np.array([1.0, 3.0]), np.ones((2, 1)), np.zeros((2, 1)))
    direct, general = schur.solved(*free, method="direct"), schur.solved(*free, method="expectations")
    for a, b in zip(direct[:3], general[:3]):
        assert np.allclose(a, b)
    assert np.allclose(direct.t, free[1] / 2) and np.allclose(direct.c, free[2] / 2)
    # without expectation errors auto takes the equations as they are, explosive ones too
    assert schur.solved(*pencil(1.5, 0.5, 0.0)).codes == (1, 1)
    with pytest.raises(ValueError, match="no direct"):
        schur.solved(*pencil(1.5, 0.5), method="direct")
    with pytest.raises(ValueError, match="g0"):
        schur.solved(np.ones((1, 2)), np.ones((1, 2)), np.zeros(1), np.ones((1, 1)), np.zeros((1, 0)))
    with pytest.raises(ValueError, match="finite.*g1"):
        schur.solved(np.eye(1), np.array([[np.nan]]), np.zeros(1), np.ones((1, 1)), np.zeros((1, 0)))
    with pytest.raises(ValueError, match="unknown method"):
        schur.solved(*free, method="qz")


def test_the_solution_solves_its_equations():
    """Along any path of a random determinate system, errors of the equations are only what the jumps allow."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.uniform(1.1, 3, 2), rng.uniform(-0.9, 0.9, 2)
        v = rng.normal(size=(4, 4))
        g0, g1 = v, v @ (w := rng.normal(size=(4, 4))) @ np.diag([*a, *b]) @ np.linalg.inv(w)
        c, psi, pi = rng.normal(size=4), rng.normal(size=(4, 2)), rng.normal(size=(4, 2))
        t, r, const, codes = schur.solved(g0, g1, c, psi, pi)
        assert codes == (1, 1) and np.abs(np.linalg.eigvals(t)).max() < 1
        free = np.linalg.svd(pi)[0][:, 2:].T  # equations without errors hold exactly
        assert np.allclose(free @ (g0 @ t - g1) @ t, 0, atol=1e-7) and np.allclose(free @ (g0 @ r - psi), 0, atol=1e-7)
        mean = np.linalg.solve(np.eye(4) - t, const)
        assert np.allclose((g0 - g1) @ mean, c, atol=1e-6)


def test_stacked_systems_are_solved_as_each_alone_and_cost_no_python_of_their_own():
    grid = [(phi, rho, link, live) for phi in np.arange(1, 51) / 25 for rho in np.arange(9) / 10 for link in (0.0, 1.0) for live in (0.0, 1.0)]
    many = [np.stack(x) for x in zip(*[pencil(*g) for g in grid])]
    found = schur.solved_many(*many, method="expectations")
    for i in range(0, len(grid), 37):
        alone = schur.solved(*(x[i] for x in many), method="expectations")
        assert alone.codes == tuple(found.codes[i])
        if alone.codes[0] >= 0:
            assert np.allclose(alone.t, found.t[i]) and np.allclose(alone.r, found.r[i]) and np.allclose(alone.c, found.c[i])
    phi, _, link, live = np.array(grid).T
    assert (found.codes[live == 0] == schur.COINCIDENT).all()
    assert (found.codes[(live == 1) & (link == 1), 1] == (phi > 1)[(live == 1) & (link == 1)]).all()
    calls, rows = [], 20
    sys.setprofile(lambda frame, event, _: calls.append(event) if event == "call" else None)
    try:
        schur.solved_many(*(np.concatenate([x] * rows) for x in many), method="expectations")
    finally:
        sys.setprofile(None)
    assert len(calls) < rows * len(grid)  # less than one a system


def test_systems_that_cannot_be_solved_leave_the_others_alone():
    good = (np.eye(2), np.diag([0.5, 0.2]), np.ones(2), np.ones((2, 1)), np.zeros((2, 1)))
    flat = (np.zeros((2, 2)), np.eye(2), np.ones(2), np.ones((2, 1)), np.zeros((2, 1)))
    many = [np.stack(x) for x in zip(good, flat, good)]
    for method in ("auto", "direct"):
        found = schur.solved_many(*many, method=method)
        assert found.codes[:, 0].tolist() == [1, -3, 1] and np.allclose(found.t[[0, 2]], good[1])


def test_rows_of_one_file_are_dealt_to_all_tasks(spark):
    m = Model({"states": 1, "shocks": 1}, (("g0", 0, 0, "1"), ("g1", 0, 0, "rho"), ("psi", 0, 0, "1")), ("rho",))
    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "id / 2000D as rho")
    out = equations.solutions(rows, ["id"], m)
    assert out.count() == 1000 and out.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


# Equations -----------------------------------------------------------------------------


def test_only_arithmetic_is_an_expression():
    for bad in ("__import__('os')", "a.b", "[1]", "a if b else c", "lambda: 1", "'x'", "open(a)", "exp(x=1)", "True", "a == b"):
        with pytest.raises(ValueError, match="not an expression"):
            equations.compiled(bad)
    with pytest.raises(ValueError, match="unknown"):
        Model({"states": 1}, (("g0", 0, 0, "alpha"),), ("beta",))
    with pytest.raises(ValueError, match="cell"):
        Model({"states": 1}, (("g0", 0, 1, "1"),), ())
    with pytest.raises(ValueError, match="twice"):
        Model({}, (), ("a",), (("a", "1"),))


def test_values_are_named_in_order_and_rows_fail_alone():
    m = Model({"states": 1, "shocks": 1}, (("g0", 0, 0, "1"), ("g1", 0, 0, "rho"), ("psi", 0, 0, "scale")), ("rho", "x"), (("scale", "sqrt(x)"), ("twice", "2 * scale")))
    at = m.values({"rho": [0.5, 0.5, 0.5], "x": [4.0, -1.0, 9.0]})
    assert np.allclose(at["twice"][[0, 2]], [4, 6]) and np.isnan(at["twice"][1])
    s, codes = m.systems(at)
    assert codes.tolist() == [[1, 1], list(equations.NOT_FINITE), [1, 1]] and np.allclose(s.R[:, 0, 0], [2, 0, 3])


def test_roots_within_brackets_and_fallback():
    r = Root("x", "exp(x) - a", "-50", "50", -1.0)
    got = Model({}, (), ("a",), (r,)).values({"a": [1.0, 20.0, -3.0, 1e-9, 5e20]})["x"]
    assert np.allclose(got, [0, np.log(20), -1.0, np.log(1e-9), np.log(5e20)], atol=1e-9)
    steep = Root("x", "x ** 9 - a", "0", "10")
    assert np.allclose(Model({}, (), ("a",), (steep,)).values({"a": [1e-6, 1.0, 1e8]})["x"], np.array([1e-6, 1.0, 1e8]) ** (1 / 9))


def test_tables_of_rows(spark):
    rows = spark.createDataFrame([(1, 0.5, "x"), (2, None, "y")], "id long, rho double, matrix string")
    cells = spark.createDataFrame([("g0", 0, 0, "1"), ("g1", 0, 0, "rho"), ("psi", 0, 0, "1")], "matrix string, row int, column int, expression string")
    m = equations.model_of(cells, {"states": 1, "shocks": 1}, ["rho"])
    got = {r.id: r for r in equations.solutions(rows, ["id"], m).collect()}
    assert (got[1].exists, got[1].unique, list(got[1].t)) == (1, 1, [0.5]) and (got[2].exists, got[2].t) == (equations.NOT_FINITE[0], None)
    assert equations.solutions(rows.limit(0), ["id"], m).collect() == []
    assert {(r.id, r.matrix, r.value) for r in equations.cells(rows.where("id = 1"), ["id"], m).collect()} == {(1, "g0", 1.0), (1, "g1", 0.5), (1, "psi", 1.0)}


def test_contract_at_known_points():
    """A contract with 3 % annual default, spread 0.5 and a premium of 1.7444 % a year."""
    from statistics import NormalDist

    z, spr = NormalDist().inv_cdf(1 - 0.97**0.25), (1 + 1.7444 / 100) ** 0.25
    got = frictions.contract(np.array([z]), np.array([0.5]), np.array([spr]))
    want = {"omega": 0.2620745217846454, "G": 0.0017043640474161438, "Gamma": 0.26179081924629516, "mu": 0.13142954165405685, "nk": 0.7372998784691602, "zeta_spb": 0.055975462717559314}
    assert {k: got[k][0] for k in want} == pytest.approx(want, rel=1e-6)


def test_contract_elasticities_are_slopes_of_its_conditions():
    """At a fixed verification cost, move the cut-off: the premium follows the best contract, net worth the lender's break-even."""
    from math import erf, exp, log, sqrt

    for z, sigma, spr in ((-2.2, 0.4, 1.003), (-1.6, 0.6, 1.006)):
        at = {k: v[0] for k, v in frictions.contract(np.array([z]), np.array([sigma]), np.array([spr])).items()}

        def point(omega):
            x = (log(omega) + sigma**2 / 2) / sigma
            below = lambda v: 0.5 * (1 + erf(v / sqrt(2)))
            g, slope = below(x - sigma), 1 - below(x)
            share, loss = omega * slope + g, exp(-x * x / 2) / sqrt(2 * np.pi) / sigma
            keeps, weight = share - at["mu"] * g, slope / (slope - at["mu"] * loss)
            s = 1 / ((1 - share) / weight + keeps)
            return log(s), log(keeps), log(1 / (1 - keeps * s))

        (s0, k0, l0), (s1, k1, l1) = point(at["omega"] * exp(-1e-4)), point(at["omega"] * exp(1e-4))
        assert point(at["omega"])[0] == pytest.approx(log(spr), abs=1e-12)
        assert at["zeta_bomega"] == pytest.approx(-(s1 - s0) / 2e-4, rel=1e-5) and at["zeta_zomega"] == pytest.approx((k1 - k0) / 2e-4, rel=1e-5)
        assert at["zeta_spb"] == pytest.approx((s1 - s0) / (l1 - l0), rel=1e-4)


# Likelihoods ---------------------------------------------------------------------------


def systems(rng, rows):
    t = rng.uniform(-0.4, 0.4, (rows, 2, 2)) + 0.4 * np.eye(2)
    q, e = np.zeros((rows, 2, 2)), np.zeros((rows, 2, 2))
    q[:, [0, 1], [0, 1]], e[:, [0, 1], [0, 1]] = rng.uniform(0.1, 1, (rows, 2)), rng.uniform(0.1, 1, (rows, 2))
    return likelihood.Systems(t, rng.normal(size=(rows, 2, 2)), rng.normal(size=(rows, 2)), q, rng.normal(size=(rows, 2, 2)), rng.normal(size=(rows, 2)), e)


def test_batched_filter_equals_the_filter_of_each_row():
    rng = np.random.default_rng(8)
    many, y = systems(rng, 30), rng.normal(size=(12, 2))
    y[3, 0] = y[5, 1] = np.nan
    y[7] = np.nan
    many.T[4] = 1.2 * np.eye(2)  # no stationary start
    for count_from, noise in ((0, None), (3, None), (0, np.stack([k * 0.1 * np.eye(2) for k in range(1, 13)]))):
        got = many.loglik(y, noise, count_from=count_from)
        want = [statespace.filtered(System(*(x[k] for x in many)), y, noise=noise, count_from=count_from)["total"] for k in range(30)]
        assert np.allclose(got, want, rtol=1e-9, atol=1e-8)
    _, s, p = many.filtered(y)
    last = statespace.filtered(System(*(x[2] for x in many)), y)
    assert np.allclose(s[2], last["state"][-1]) and np.allclose(p[2], last["cov"][-1])


def test_a_row_without_density_fails_alone():
    many = systems(np.random.default_rng(1), 3)
    many.E[1], many.Z[1] = 0, 0
    got = many.loglik(np.ones((4, 2)))
    assert got[1] == -np.inf and np.isfinite(got[[0, 2]]).all()
    with pytest.raises(ValueError, match="count_from"):
        many.loglik(np.ones((4, 2)), count_from=5)


# Optimisers ----------------------------------------------------------------------------


# lambdas travel to tasks by value
banana = lambda x, row: -((row["a"] - x[:, 0]) ** 2) - 10 * (x[:, 1] - x[:, 0] ** 2) ** 2


@pytest.mark.parametrize("method", ["simplex", "directions"])
def test_optima_of_curved_valleys(spark, method):
    points = spark.createDataFrame([(k, [-1.0, 2.0 - k], 0.5 + k / 4) for k in range(6)], "id long, x array<double>, a double")
    for r in estimation.optima(points, ["id"], banana, ["a"], method, tolerance=1e-9).collect():
        a = 0.5 + r.id / 4
        assert r.settled and np.allclose(r.x, [a, a * a], atol=2e-3) and r.value == pytest.approx(0, abs=1e-5)


def test_optima_beside_a_cliff(spark):
    """Half the plane has no value: searches stay on their side."""
    f = lambda x, row: np.where(x[:, 0] > 0, -((x[:, 0] - 0.01) ** 2) - x[:, 1] ** 2, np.nan)
    points = spark.createDataFrame([(1, [2.0, 1.0])], "id long, x array<double>")
    for method in estimation.METHODS:
        r = estimation.optima(points, ["id"], f, method=method).first()
        assert np.allclose(r.x, [0.01, 0], atol=1e-3)
    with pytest.raises(PythonException, match="finite at a start"):
        estimation.optima(spark.createDataFrame([(1, [-2.0, 1.0])], "id long, x array<double>"), ["id"], f).collect()


def test_hessians_of_rows(spark):
    f = lambda x, row: -row["k"] * x[:, 0] ** 2 - 3 * x[:, 0] * x[:, 1] + np.where(x[:, 1] > 50, np.nan, 0.0)
    points = spark.createDataFrame([(1, [0.5, -2.0], 1.0), (2, [3.0, 0.0], 4.0), (3, [1.0, 50.0], 1.0)], "id long, x array<double>, k double")
    h = {(r.id, r.i, r.j): r.value for r in estimation.hessians(points, ["id"], f, 2, ["k"], 1e-3).collect()}
    for i, k in ((1, 1.0), (2, 4.0)):
        assert h[i, 0, 0] == pytest.approx(-2 * k, abs=1e-5) and h[i, 0, 1] == h[i, 1, 0] == pytest.approx(-3, abs=1e-5) and h[i, 1, 1] == pytest.approx(0, abs=1e-5)
    assert h[3, 1, 1] is None and len(h) == 12


def test_proposal_covariance():
    h = -np.array([[4.0, 1.0], [1.0, 2.0]])
    assert np.allclose(estimation.proposal_covariance(h) @ -h, np.eye(2))
    for bad in (np.diag([1.0, -1.0]), np.zeros((2, 2))):
        with pytest.raises(np.linalg.LinAlgError):
            estimation.proposal_covariance(bad)


# Chains --------------------------------------------------------------------------------

STARTS = "chain long, x array<double>, m double"


normal = lambda x, row: -0.5 * ((x[:, 0] - row["m"]) ** 2 + (x[:, 1] + row["m"]) ** 2 / 4)


def run(spark, sampler, rows=4, **more):
    starts = spark.createDataFrame([(k, [float(k), 0.0], float(k)) for k in range(rows)], STARTS)
    return estimation.chains(starts, "chain", normal, sampler, ["m"], **more)


def plain(df):
    return sorted((r.chain, r.sweep, tuple(r.x), r.logpost, r.accepted, r.scale, r.kept) for r in df.where("kept").collect())


def test_chains_find_their_normals(spark):
    sampler = estimation.Sampler(np.diag([2.0, 8.0]), draws=1500, seed=5, burn=100)
    draws = estimation.draws_of(run(spark, sampler), "chain").toPandas()
    assert draws.groupby("chain").size().eq(1400).all() and draws.groupby("chain").draw.max().eq(1399).all()
    for k, part in draws.groupby("chain"):
        x = np.stack(part.x)
        assert np.allclose(x.mean(axis=0), [k, -k], atol=0.35) and np.allclose(x.std(axis=0), [1, 2], rtol=0.2)


@pytest.mark.parametrize("more", [{}, {"blocks": 2, "rounds": 3, "target": 0.3, "alpha": 0.8, "thin": 2, "burn_rounds": 1}])
def test_resumed_and_repeated_chains_are_the_same(spark, more):
    sampler = estimation.Sampler(np.diag([2.0, 8.0]), draws=20, seed=9, **more)
    whole = plain(run(spark, sampler))
    assert len(whole) == 4 * (sampler.rounds - sampler.burn_rounds) * 20
    assert plain(run(spark, sampler, every=7)) == whole
    # two of the chains alone, and all of them from what an ended run had written
    assert plain(run(spark, sampler, rows=2)) == [r for r in whole if r[0] < 2]
    ended = run(spark, sampler, every=7)
    state = ended.where("sweep <= 13")
    assert plain(run(spark, sampler, every=50, state=state)) == whole


def test_adaptive_rounds_move_the_scale_towards_the_target(spark):
    sampler = estimation.Sampler(np.diag([1.0, 4.0]), draws=30, seed=2, rounds=12, scale=6.0, target=0.5, alpha=1.0)
    scales = run(spark, sampler, rows=1).toPandas().sort_values("sweep").scale.to_numpy()
    assert scales[0] == pytest.approx(6.0) and (np.diff(scales[::30]) < 0).all()  # too few are accepted at first
    assert 0.95**12 * 6 <= scales[-1] < 6


def test_correction_is_the_ratio_of_two_mixtures():
    rng = np.random.default_rng(3)
    c = np.array([[1.0, 0.4], [0.4, 2.0]])
    x, y = rng.normal(size=(2, 2))
    density = lambda at, mean, cov: np.exp(-0.5 * (at - mean) @ np.linalg.solve(cov, at - mean)) / (2 * np.pi * np.sqrt(np.linalg.det(cov)))
    for alpha, scale in ((0.9, 0.5), (0.3, 2.0), (1.0, 1.0)):
        s = c * scale**2
        q = lambda at, mean: alpha * density(at, mean, s) + (1 - alpha) / 2 * density(at, mean, np.diag(np.diag(s))) + (1 - alpha) / 2 * density(at, y, s)
        assert estimation.correction(y, x, c, alpha, scale) == pytest.approx(np.log(q(x, y) / q(y, x)))
    assert estimation.correction(y, x, c, 0.0, 1.0) == 0.0


def test_sampler_refuses_what_makes_no_sense(spark):
    for bad in ({"draws": 0}, {"thin": 0}, {"blocks": 3}, {"burn_rounds": 2}, {"alpha": 1.5}, {"scale": 0.0}, {"target": 2.0}):
        with pytest.raises(ValueError):
            estimation.Sampler(np.eye(2), **({"draws": 1, "seed": 1} | bad))
    with pytest.raises(np.linalg.LinAlgError):
        estimation.Sampler(-np.eye(2), draws=1, seed=1)
    lost = spark.createDataFrame([(1, [0.0, 0.0], None)], STARTS)
    with pytest.raises(PythonException, match="finite"):
        estimation.chains(lost, "chain", normal, estimation.Sampler(np.eye(2), draws=2, seed=1), ["m"])


def test_kalman_posterior_chain_against_a_grid(spark):
    rng = np.random.default_rng(12)
    y, s = [], 0.0
    for _ in range(60):
        s = 0.6 * s + 0.3 * rng.normal()
        y.append([1.4 + s + 0.1 * rng.normal()])
    f = series_posterior(np.array(y))
    r, line = (g.ravel() for g in np.meshgrid(np.linspace(-0.2, 0.98, 80), np.linspace(-2.5, -0.3, 80), indexing="ij"))
    row = {"mu": np.full(len(r), 1.4), "noise": np.full(len(r), 0.1)}
    logp = f(np.column_stack([r, line]), row)
    w = np.exp(logp - logp.max())
    grid = np.array([w @ r, w @ line]) / w.sum()
    starts = spark.createDataFrame([(k, [0.5, -1.2], 1.4, 0.1) for k in range(8)], "chain long, x array<double>, mu double, noise double")
    out = estimation.draws_of(estimation.chains(starts, "chain", f, estimation.Sampler(np.diag([0.03, 0.03]), draws=400, seed=3, burn=50), ["mu", "noise"]), "chain")
    assert np.allclose(np.stack(out.toPandas().x).mean(axis=0), grid, atol=0.06)


def test_likelihood_table(spark):
    rows = spark.createDataFrame(pd.DataFrame({"id": [1, 2], "rho": [0.5, 0.9], "sigma": [0.2, 0.3], "mu": [0.0, 1.0], "noise": [0.1, 0.2]}))
    y = np.array([[0.3], [np.nan], [0.1]])
    got = {r.id: r.loglik for r in equations.log_likelihoods(rows, ["id"], NOISY, y).collect()}
    for k, rho, sigma, mu, noise in rows.collect():
        assert got[k] == pytest.approx(statespace.filtered(System.of(rho, 1.0, sigma**2, 1.0, noise**2, D=[mu]), y)["total"])
    data = spark.createDataFrame([(2, None, 1.0), (1, 0.5, None)], "q int, a double, b double")
    assert np.allclose(likelihood.collected(data, "q", ["a", "b"]), [[0.5, np.nan], [np.nan, 1.0]], equal_nan=True)
