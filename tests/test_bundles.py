"""Report bundles, files of observables, long chains and concentrated quantiles."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quartermill.operators import bands, bundles, diagnostics
from quartermill.operators.ingest import CoverageError
from quartermill.operators.observables import Observable, observed
from quartermill.sources import build, levels


def test_axes_and_their_labels(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 3.0)], "i int, v double")
    assert sorted(map(tuple, bundles.labelled(rows, "i", ["a", "b"], "axis").collect())) == [(1.0, "a"), (2.0, "b"), (3.0, "b")]
    for labels in (["a"], ["a", "b", "c"]):
        with pytest.raises(Exception, match="labels for 2 entries"):
            bundles.labelled(rows, "i", labels, "axis").collect()


def test_tables_side_by_side_and_files_in_order(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0)], "k string, q int, v double")
    b = spark.createDataFrame([("x", 2, 20.0), ("x", 1, 10.0)], "k string, q int, w double")
    assert sorted(map(tuple, bundles.in_parallel(a, b, ["k"], "q").collect())) == [("x", 1, 1.0, 10.0), ("x", 2, 2.0, 20.0)]
    for other in (b.where("q = 1"), b.unionByName(b.where("q = 2"))):
        with pytest.raises(Exception, match="quarters differ, first at 2"):
            bundles.in_parallel(a, other, ["k"], "q").collect()
    frame = lambda *q: spark.createDataFrame(list(enumerate(q)), "place int, q int")
    assert bundles.in_order(frame(1, 2, 4), "place", "q").count() == 3
    for q, fault in (((1, 1), "repeated"), ((2, 1), "ascending"), ((1, None), "missing")):
        with pytest.raises(Exception, match=f"{fault}.*row 1"):
            bundles.in_order(frame(*q), "place", "q").collect()


def test_reconciliation_gate(spark):
    rows = spark.createDataFrame([(0, "v", "a", 1.0, 3.0), (0, "v", "b", 2.0, 3.0)], "t int, variable string, driver string, contribution double, observed double")
    assert bundles.reconciled(rows).count() == 2
    with pytest.raises(Exception, match="miss the observed path"):
        bundles.reconciled(rows.withColumn("observed", F.lit(3.1))).collect()


def test_bundle_files(spark, tmp_path):
    small = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string")
    path = str(tmp_path / "b")
    manifest = bundles.write_bundle(path, "irf_report", {"lines": spark.range(5000), "top": small}, text=["top"], horizon=4)
    assert json.loads(spark.read.text(f"{path}/manifest").first()[0]) == manifest == {"kind": "irf_report", "horizon": 4, "tables": {"lines": ["id"], "top": ["n", "s"]}}
    page = "\n".join(r[0] for r in spark.read.text(f"{path}/page", wholetext=True).collect())
    assert page.startswith("# irf report\n\n- horizon: 4") and r"| 1 | a\|b |" in page
    assert spark.read.parquet(f"{path}/lines").count() == 5000
    with pytest.raises(ValueError, match="over 1000 rows"):
        bundles.write_bundle(path, "x", {"lines": spark.range(5000)}, text=["lines"])
    with pytest.raises(ValueError):
        bundles.write_bundle(path, "x", {"lines": small}, text=["other"])


def test_bench_reports_round_trip(spark, tmp_path):
    kind = "machine string, command map<string,string>, kernel string, backend string, device string, horizon int, repeats int, dtype string, elapsed_seconds double, skipped boolean, available boolean, reason string"
    rows = spark.createDataFrame([("m1", {"draws": "8"}, k, "numpy", "cpu", 4, 3, "float64", s, False, True, None) for k, s in (("filter", 0.5), ("forecast", 0.25))], kind)
    bundles.bench_report(rows, str(tmp_path / "r"))
    back = levels.read_reports(spark, str(tmp_path / "r" / "*"))
    assert [(x.kernel, x.elapsed_seconds) for r in back.collect() for x in r.results] == [("filter", 0.5), ("forecast", 0.25)]


LEVELS = "date,GDP,GDPDEF,CNP16OV,DFF\n" + "\n".join(f"{2000 + q // 4}-Q{q % 4 + 1},{1000 + 10 * q},{90 + q},{200000 + 300 * q},{2 + q / 10}" for q in range(12))
OBSERVABLES = [Observable("obs_gdp", "gdp_growth", ("GDP__FRED", "GDPDEF__FRED")), Observable("obs_rate", "nominal_rate", ("DFF__FRED",))]


def test_observables_are_built_and_read_back(spark, tmp_path):
    (tmp_path / "levels.csv").write_text(LEVELS)
    got = build.build_observables(spark, str(tmp_path / "levels.csv"), OBSERVABLES, str(tmp_path / "out"), hpfilter_population=False).toPandas().sort_values("quarter_idx")
    want = observed(levels.read_wide(spark, str(tmp_path / "levels.csv")), OBSERVABLES, hpfilter_population=False).toPandas().sort_values("quarter_idx")
    assert np.allclose(got[["obs_gdp", "obs_rate"]], want[["obs_gdp", "obs_rate"]], equal_nan=True) and got.quarter_idx.tolist() == want.quarter_idx.tolist()
    assert got.obs_gdp.notna().sum() == 11 and np.allclose(got.obs_rate, (2 + np.arange(12) / 10) / 4)
    assert levels.read_observables(spark, [str(tmp_path / "out" / next(p.name for p in (tmp_path / "out").glob("*.csv")))]).count() == 12


def test_observables_from_a_folder_of_sources(spark, tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    name = levels.located(spark, levels.requirements(spark.createDataFrame([(0, "GDP__FRED")], "ord int, name string"), []), str(root), "160101").first().candidates[0]
    with pytest.raises(CoverageError, match="no file of .*FRED"):
        build.build_from_sources(spark, str(root), "160101", OBSERVABLES, str(tmp_path / "out"))
    (root / name.rpartition("/")[2]).write_text(LEVELS)
    got = build.build_from_sources(spark, str(root), "160101", OBSERVABLES, str(tmp_path / "out"))
    assert got.count() == 12 and got.where("obs_gdp is not null").count() == 11


def test_downloaded_levels_and_requests(spark, tmp_path):
    rows = [("A", "2000-01-15", 1.0), ("A", "2000-02-15", 3.0), ("A", "2000-05-01", 5.0), ("B", "2000-03-31", None), ("B", "2000-01-31", 7.0)]
    payload = spark.createDataFrame(rows, "series string, date string, value double")
    for how, want in (("mean", (2.0, 7.0)), ("sum", (4.0, 7.0)), ("last", (3.0, 7.0))):
        got = {r.quarter_idx: (r.A, r.B) for r in build.write_levels(payload, str(tmp_path / how), how).collect()}
        assert got == {8001: want, 8002: (5.0, None)}
    assert build.request("GDP", vintage="2020-01-01") == {"series_id": "GDP", "vintage_dates": "2020-01-01", "output_type": "2"}
    assert build.request("GDP", realtime=("2020-01-01", "2020-02-01"))["output_type"] == "1" and build.request("GDP") == {"series_id": "GDP"}
    for bad in ({"vintage": "x", "realtime": ("a", "b")}, {"realtime": ("b", "a")}, {"output": 5}, {"series": ""}):
        with pytest.raises(ValueError):
            build.request(**({"series": "GDP"} | bad))


def plain_size(x):
    n, x = len(x), x - x.mean()
    total = 0.0
    for lag in range(1, n):
        rho = x[:-lag] @ x[lag:] / ((n - lag) * (x @ x / n))
        if not rho > 0:
            break
        total += rho
    return n / max(1.0, 1 + 2 * total)


def test_effective_sizes_by_blocks_and_further_lags(spark):
    rng, made = np.random.default_rng(4), {}
    for name, n, rho in (("slow", 3000, 0.99), ("fast", 700, 0.2), ("short", 3, 0.0), ("one", 1, 0.0)):
        x = rng.normal(size=n)
        for t in range(1, n):
            x[t] += rho * x[t - 1]
        made[name] = x
    made["flat"] = np.ones(50)
    rows = pd.concat([pd.DataFrame({"chain": k, "draw": np.arange(len(x)), "value": x}) for k, x in made.items()])
    draws = spark.createDataFrame(rows).repartition(3)
    for lags, block in ((256, 1 << 16), (4, 100), (64, 64)):
        got = {r.chain: (r.n, r.ess) for r in diagnostics.effective_size(draws, ["chain"], "draw", "value", lags, block).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: len(x) for k, x in made.items()}
        for k in ("slow", "fast", "short"):
            assert got[k][1] == pytest.approx(min(len(made[k]), plain_size(made[k])), rel=1e-6), (k, lags)
        assert got["one"][1] == 1 and got["flat"][1] == 50


def test_lagged_products_by_transforms():
    rng = np.random.default_rng(1)
    x, after = rng.normal(size=5000), rng.normal(size=400)
    y = np.concatenate([x, after])
    want = [x[: max(0, len(y) - k)] @ y[k : k + 5000] for k in range(401)]
    assert np.allclose(diagnostics.lagged_products(x, after, 400), want)


def test_chains_are_numbered_over_many_tasks(spark):
    rows = spark.range(20_000, numPartitions=7).select(F.lit("a").alias("chain"), (F.col("id") * 7919 % 20_000).alias("draw")).unionByName(spark.createDataFrame([(None, 5), (None, 3)], "chain string, draw long"))
    got = diagnostics.numbered(rows, ["chain"], "draw", F.col("draw").alias("d"))
    assert got.where("chain = 'a' and (i <> d or n <> 20000)").count() == 0 and got.where("chain = 'a'").count() == 20_000
    assert sorted((r.d, r.i, r.n) for r in got.where("chain is null").collect()) == [(3, 0, 2), (5, 1, 2)]
    rates = diagnostics.acceptance_windows(rows.where("chain = 'a'").withColumn("accepted", F.col("draw") < 10_000), ["chain"], "draw", 3).collect()
    assert sorted((r.window, r.n) for r in rates) == [(1, 6667), (2, 6667), (3, 6666)] and sum(r.rate * r.n for r in rates) == pytest.approx(10_000)


@pytest.mark.parametrize("low, high", [(0.0, 0.01), (1.0, 1.0001), (-1e-9, 1e-9), (-50.0, 1e6)])
def test_quantiles_of_values_close_together(spark, low, high):
    x = np.random.default_rng(3).uniform(low, high, 20_000)
    x[:50] = low
    x[50:60] = 0.0
    got = bands.bands(spark.createDataFrame(pd.DataFrame({"k": 1, "v": x})).repartition(3), ["k"], "v").first()
    assert [got.lower, got.upper] == pytest.approx(np.quantile(x, [0.05, 0.95]).tolist(), rel=1e-12) and got.mean == pytest.approx(x.mean(), rel=1e-9)
