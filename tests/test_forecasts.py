"""Forecast driver, scenario runner and time-varying noise against the one-row kernels."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from quartermill.functions import transforms as T
from quartermill.plans import estimation, forecasting, likelihood, package, posterior, statespace
from quartermill.plans.equations import Model
from quartermill.plans.statespace import System

#: Two states (an autoregression and its lag), two shocks, two observables.
TWO = Model(
    {"states": 2, "shocks": 2, "observables": 2},
    (("g0", 0, 0, "1"), ("g0", 1, 1, "1"), ("g1", 0, 0, "rho"), ("g1", 0, 1, "0.1"), ("g1", 1, 1, "0.5"), ("c", 0, 0, "level"), ("psi", 0, 0, "1"), ("psi", 1, 1, "1"),
     ("z", 0, 0, "1"), ("z", 1, 0, "0.5"), ("z", 1, 1, "1"), ("d", 1, 0, "level"), ("q", 0, 0, "0.04"), ("q", 1, 1, "0.09"), ("eps", 0, 0, "0.01"), ("eps", 1, 1, "0.02")),
    ("rho", "level"),
)
ROWS = [(1, 0.7, 0.1), (2, 0.2, -0.3), (3, None, 0.0)]
DATA = np.random.default_rng(2).normal(size=(9, 2))
DATA[2, 0] = DATA[6] = np.nan


def one(rho, level):
    s, _ = TWO.systems(TWO.values({"rho": [rho], "level": [level]}))
    return System(*(x[0] for x in s))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, rho double, level double").repartition(2)


def values(df, *keys):
    out = {}
    for r in df.where("part <> 'no solution'").collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r.h, r.variable] = r.value
    return {k: np.array([[v[h, i] for i in range(2)] for h in range(len(v) // 2)]) for k, v in out.items()}


def test_forecasts_start_where_filters_end_and_failures_have_a_row(spark, rows):
    out = forecasting.forecasts(rows, ["id"], TWO, DATA, 5)
    for (k,), y in values(out, "id").items():
        m = one(*ROWS[k - 1][1:])
        last = statespace.filtered(m, DATA)["state"][-1]
        assert np.allclose(y, statespace.simulated(m, last, np.zeros((5, 2))) @ m.Z.T + m.D)
    lost = out.where("part = 'no solution'").collect()
    assert [(r.id, r.h, r.variable, r.value) for r in lost] == [(3, None, None, None)]
    assert forecasting.forecasts(rows.limit(0), ["id"], TWO, DATA, 5).collect() == []


def test_conditions_on_the_last_periods(spark, rows):
    semi, full = (forecasting.forecasts(rows, ["id"], TWO, DATA, 5, cond, 3) for cond in ("semi", "full"))
    for (k,), y in values(full, "id").items():
        m = one(*ROWS[k - 1][1:])
        start = statespace.filtered(m, DATA[:6])["state"][-1]
        e = statespace.conditioned(m, start, DATA[6:])
        path = statespace.simulated(m, start, np.vstack([e, np.zeros((2, 2))])) @ m.Z.T + m.D
        assert np.allclose(y, path, atol=1e-8) and np.allclose(y[1:3], DATA[7:], atol=1e-8)
    assert {(r.part, r.h) for r in full.where("id = 1").collect()} == {("conditional", h) for h in range(3)} | {("forecast", h) for h in (3, 4)}
    for (k,), y in values(semi.withColumn("h", semi.h - 3), "id").items():
        m = one(*ROWS[k - 1][1:])
        assert np.allclose(y, statespace.simulated(m, statespace.filtered(m, DATA)["state"][-1], np.zeros((2, 2))) @ m.Z.T + m.D)
    for bad in (("half", 1, 5), ("full", 10, 20), ("semi", 4, 3)):
        with pytest.raises(ValueError):
            forecasting.forecasts(rows, ["id"], TWO, DATA, bad[2], bad[0], bad[1])


def test_cubes_of_shocks(spark, rows):
    cells = [(1, 7, 0, 0, 1.0), (1, 7, 2, 1, -0.5), (1, 8, 1, 0, 2.0), (2, 7, 0, 1, 0.3), (1, 7, 9, 0, 99.0), (3, 7, 0, 0, 1.0)]
    cube = spark.createDataFrame(cells, "id long, draw long, h int, shock int, value double")
    out = forecasting.forecasts(rows, ["id"], TWO, DATA, 4, shocks=cube)
    found = values(out, "id", "draw")
    assert set(found) == {(1, 7), (1, 8), (2, 7)} and out.where("part = 'no solution'").count() == 1
    for (k, draw), y in found.items():
        m, e = one(*ROWS[k - 1][1:]), np.zeros((4, 2))
        for i, d, h, s, v in cells:
            if (i, d) == (k, draw) and h < 4:
                e[h, s] += v
        assert np.allclose(y, statespace.simulated(m, statespace.filtered(m, DATA)["state"][-1], e) @ m.Z.T + m.D)


def test_draws_of_one_row_share_its_system_and_filter(monkeypatch):
    seen, filtered = [], likelihood.Systems.filtered
    monkeypatch.setattr(likelihood.Systems, "filtered", lambda self, *a, **k: seen.append(len(self.C)) or filtered(self, *a, **k))
    given = np.array([(0.7, 0.1), (0.2, -0.3), (np.nan, 0.0), (2.0, 0.0)] * 500)
    e = np.random.default_rng(3).normal(size=(2000, 4, 2))
    y, found = forecasting.drawn(TWO, given, e, DATA, "full", 2, "auto")
    assert seen == [3]  # 1,500 before: a filter a draw
    assert found.reshape(500, 4).tolist() == [[True, True, False, True]] * 500 and y.shape == (1500, 6, 2)
    for i in (0, 1, 1499):  # rows with a solution, by their place among these
        row = i // 3 * 4 + (0, 1, 3)[i % 3]
        m = one(*given[row])
        start = statespace.filtered(m, DATA[:7])["state"][-1]
        both = np.vstack([statespace.conditioned(m, start, DATA[7:]), e[row]])
        assert np.allclose(y[i], statespace.simulated(m, start, both) @ m.Z.T + m.D, atol=1e-6)


def test_lists_of_shocks():
    cells = pa.array([[{"h": 1, "shock": 0, "value": 2.0}, {"h": 1, "shock": 0, "value": 0.5}], [], None, [{"h": 0, "shock": 1, "value": -1.0}]], pa.list_(pa.struct([("h", pa.int32()), ("shock", pa.int32()), ("value", pa.float64())])))
    want = np.zeros((4, 2, 2))
    want[0, 1, 0], want[3, 0, 1] = 2.5, -1.0
    assert np.array_equal(forecasting._shocks(cells, 2, 2), want) and np.array_equal(forecasting._shocks(cells[1:], 2, 2), want[1:])
    with pytest.raises(ValueError, match="shocks"):
        forecasting._shocks(cells, 2, 1)


def test_histories(spark, rows):
    for smooth in (False, True):
        got = forecasting.histories(rows, ["id"], TWO, DATA, "semi", 2, smooth).toPandas()
        assert set(got.id) == {1, 2} and got.t.max() == 6
        m = one(*ROWS[0][1:])
        f = statespace.filtered(m, DATA)
        want = (statespace.smoothed(m, f)[0] if smooth else f["state"])[:7]
        part = got[got.id == 1].sort_values(["t", "state"])
        assert np.allclose(part.value.to_numpy().reshape(7, 2), want)


def test_scenarios_of_each_kind(spark):
    m = one(0.7, 0.1)
    s0 = np.array([0.3, -0.2])
    base = statespace.simulated(m, s0, np.zeros((5, 2))) @ m.Z.T + m.D
    rows = [("p", "policy", h, "y0", 0.1 * (h + 1)) for h in range(3)] + [("s", "structural", 1, "b", 2.0), ("s", "structural", 1, "b", 1.0)] + [("c", "condition", 2, "y1", -1.0), ("late", "structural", 9, "a", 1.0)]
    table = spark.createDataFrame(rows, "scenario string, kind string, h int, name string, value double")
    got = forecasting.run_scenarios(table, "scenario", m, s0, 5, ["a", "b"], ["y0", "y1"], "a").toPandas()
    get = lambda k, part, name: got[(got.scenario == k) & (got.part == part) & (got.name == name)].sort_values("h").value.to_numpy()
    assert np.allclose(get("p", "path", "y0")[:3] - base[:3, 0], [0.1, 0.2, 0.3]) and np.allclose(get("p", "shock", "b"), 0)
    assert np.allclose(get("s", "shock", "b"), [0, 3, 0, 0, 0]) and get("s", "summary", "largest shock")[0] == pytest.approx(3)
    assert get("c", "path", "y1")[2] - base[2, 1] == pytest.approx(-1) and get("c", "summary", "miss")[0] < 1e-9
    e = statespace.conditioned(m, s0, np.where(np.arange(10).reshape(5, 2) == 5, base - 1, np.nan))
    assert np.allclose(get("c", "shock", "a") * 0.2, e[:, 0]) and get("c", "summary", "joint norm")[0] == pytest.approx(np.linalg.norm(e / [0.2, 0.3], axis=1).max())
    assert np.allclose(get("late", "path", "y0"), base[:, 0])
    for bad in ([("x", "policy", 0, "y0", 1.0), ("x", "structural", 0, "a", 1.0)], [("x", "policy", 0, "nobody", 1.0)], [("x", "other", 0, "y0", 1.0)]):
        with pytest.raises(PythonException):
            forecasting.run_scenarios(spark.createDataFrame(bad, table.schema), "scenario", m, s0, 5, ["a", "b"], ["y0", "y1"], "a").collect()


def test_noise_of_some_periods(spark):
    m = one(0.7, 0.1)
    y = spark.createDataFrame(pd.DataFrame({"key": "k", "t": range(9), "a": DATA[:, 0], "b": DATA[:, 1]}))
    cells = spark.createDataFrame([(3, 0, 0, 1.0), (3, 1, 1, 2.0), (3, 0, 1, 0.5), (3, 1, 0, 0.5), (4, 1, 1, 0.0)], "t long, i int, j int, value double")
    got = statespace.filter_groups(y, "key", "t", ["a", "b"], m, noise=cells).toPandas()
    q = [m.Q] * 9
    q[3], q[4] = np.array([[1.0, 0.5], [0.5, 2.0]]), np.zeros((2, 2))
    want = statespace.filtered(m, DATA, noise=[m.R @ x @ m.R.T for x in q])
    assert np.allclose(got.sort_values("t").loglik, want["loglik"]) and np.allclose(np.stack(got.sort_values("t").state), want["state"])


def test_estimate_from_starts_to_draws(spark):
    f = lambda x, row: -0.5 * ((x[:, 0] - row["a"]) ** 2 + 4 * x[:, 1] ** 2) - np.where(row["a"] == 2, 3.0, 0.0)
    starts = spark.createDataFrame([(1, [3.0, 1.0], 2.0), (2, [0.0, 1.0], 2.0), (3, [0.0, -1.0], 1.0)], "id long, x array<double>, a double")
    out = estimation.estimate(starts, "id", f, 2, ["a"], method="simplex", step=1e-3, draws=40, seed=3, rounds=2)
    assert np.allclose(out.covariance, np.diag([1, 0.25]), atol=1e-4) and out.hessian.count() == 4
    assert {r.id: np.round(r.x, 3).tolist() for r in out.mode.collect()}[3] == [1.0, 0.0]
    assert estimation.draws_of(out.states, "id").groupBy("id").count().where("count = 80").count() == 3
    given = estimation.estimate(starts, "id", f, 2, ["a"], mode=out.mode)
    assert given.states is None and given.hessian is None
    for bad in ({}, {"method": "simplex", "mode": out.mode}, {"method": "simplex", "draws": 5, "seed": 1}, {"method": "simplex", "step": 1e-3, "covariance": np.eye(2)}, {"method": "simplex", "step": 1e-3, "draws": 5}, {"method": "simplex", "thin": 2}):
        with pytest.raises(ValueError):
            estimation.estimate(starts, "id", f, 2, ["a"], **bad)


def test_packages(spark, tmp_path):
    row = spark.createDataFrame([(1, 0.7, 0.1)], "id long, rho double, level double")
    conditions = spark.createDataFrame([("tight", "policy", 0, "y0", 0.2), ("hit", "structural", 0, "b", 1.0)], "scenario string, kind string, h int, name string, value double")
    cube = spark.createDataFrame([(1, d, 0, 0, d / 10) for d in range(5)], "id long, draw long, h int, shock int, value double")
    path = str(tmp_path / "q")
    manifest = package.quarterly_package(row, "id", TWO, DATA, 6, conditions, ["a", "b"], ["y0", "y1"], "a", path, cube, quarter="2020-Q1")
    assert set(manifest["tables"]) == {"baseline", "bands", "history", "responses", "scenarios", "shocks", "summaries"} and manifest["quarter"] == "2020-Q1"
    read = lambda name, at=path: spark.read.parquet(f"{at}/{name}")
    m = one(0.7, 0.1)
    base = statespace.simulated(m, statespace.filtered(m, DATA)["state"][-1], np.zeros((6, 2))) @ m.Z.T + m.D
    got = {(r.h, r.variable): r.value for r in read("baseline").collect()}
    assert got == {(h, f"y{v}"): pytest.approx(base[h, v]) for h in range(6) for v in range(2)}
    mid = read("bands").where("h = 0 and variable = 'y0'").first()
    assert mid["mean"] == pytest.approx(base[0, 0] + 0.2) and read("history").count() == 18
    assert read("scenarios").where("scenario = 'tight' and h = 0 and variable = 'y0'").first().deviation == pytest.approx(0.2)
    assert [tuple(r) for r in read("shocks").where("scenario = 'hit'").collect()] == [("hit", 0, "b", 1.0)]
    assert read("summaries").count() == 2 and read("responses").where("mover = 1").count() == 12
    with pytest.raises(ValueError, match="one row"):
        package.quarterly_package(row.unionByName(row), "id", TWO, DATA, 6, conditions, ["a", "b"], ["y0", "y1"], "a", path)

    level = spark.createDataFrame([(h, 4.0) for h in range(20)], "h int, value double")
    targets = spark.createDataFrame([("five", 5.0), ("seven", 7.0)], "scenario string, target double")
    path = str(tmp_path / "s")
    package.study_package(row, TWO, DATA, level, targets, "y1", -0.5, ["a", "b"], ["y0", "y1"], path)
    stress = {r.target: r for r in read("stress", path).collect()}
    assert {t: (pytest.approx(t), 3, 3) for t in (5.0, 7.0)} == {t: (r.peak, r.peak_h, r.reached_h) for t, r in stress.items()}
    assert {r.scenario for r in read("paths", path).collect()} == {"five", "seven", "a_1sd", "b_1sd"}


def test_domains_definiteness_and_shown_numbers(spark):
    v = spark.createDataFrame([("exponential", 2.0), ("bounded", None), ("plain", -1.0)], "kind string, v double")
    line = lambda df: [r[0] for r in df.select(T.to_line_checked("kind", "v", F.lit(0.0), F.lit(1.0))).collect()]
    assert line(v) == [pytest.approx(np.log(2.0)), None, -1.0]
    for bad in (("exponential", -1.0), ("bounded", 1.5), ("square", -2.0)):
        with pytest.raises(Exception, match="outside its domain"):
            line(spark.createDataFrame([bad], v.schema))
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(T.shown("x", 0)).collect()] == [0.0, 2.0, 2.0]
    cells = lambda m: spark.createDataFrame([("k", i, j, float(m[i][j])) for i in range(2) for j in range(2)], "key string, i int, j int, value double")
    assert posterior.proposal_scale(cells([[2, 1], [1, 2]]), 2.0).where("value = 8").count() == 2
    with pytest.raises(Exception, match="not positive definite"):
        posterior.proposal_scale(cells([[1, 2], [2, 1]]), 1.0).collect()
