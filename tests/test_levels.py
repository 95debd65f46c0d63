"""Source files, archives, population helpers, contracts and bands on small frames."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartermill.functions import transforms as T
from quartermill.operators import accounting, bands, compare, diagnostics, frames, ingest, observables
from quartermill.plans import frictions, posterior
from quartermill.sources import archives, levels


def test_observables_file(spark, tmp_path):
    (tmp_path / "data").mkdir()
    paths = levels.candidate_paths(str(tmp_path), "160101", 5)
    assert [p.rpartition("/")[2] for p in paths[:3]] == ["data_160101.csv", "data_vint=160101.csv", "data_dsid=05_vint=160101.csv"]
    with pytest.raises(FileNotFoundError):
        levels.read_observables(spark, paths)
    (tmp_path / "data_160101.csv").write_text("date,a,b\n2016-Q1,1,\n2016-04-01,x,\n")
    assert [tuple(r) for r in levels.read_observables(spark, paths, check_empty=False).collect()] == [(8065, 1.0, None), (8066, None, None)]
    with pytest.raises(ingest.CoverageError, match="b"):
        levels.read_observables(spark, paths)


def test_sources_that_lack_something_raise(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (2, 2.0), (4, None)], "quarter_idx int, g double")
    found = {(r.fault, r.what) for r in levels.faults(df, "X", ["g", "h", "o"], ["o"], 1, 4).collect()}
    assert found == {("repeated quarter", "0-Q2"), ("missing quarter", "0-Q3"), ("missing value", "g 0-Q4"), ("missing column", "h")}
    with pytest.raises(ingest.CoverageError, match="missing quarter 0-Q3"):
        levels.levels_from_sources({"X": (df, ["g"])}, quarters=(1, 4))
    fine = levels.levels_from_sources({"X": (df.where("g is not null"), ["g", "o"])}, ["o"], (1, 2))
    assert [tuple(r) for r in fine.collect()] == [(1, 1.0, None), (2, 2.0, None)]


def test_fixtures_labels_and_reports(spark, tmp_path):
    root = tmp_path / "fix"
    (root / "sub").mkdir(parents=True)
    np.save(root / "a.npy", np.arange(4.0).reshape(2, 2))
    np.savez(root / "sub" / "z.npz", m=np.ones(3))
    (root / "c.csv").write_text("1,2\n3,4\n")
    (root / "words.csv").write_text("x,y\n")
    cells = levels.read_fixtures(spark, str(root)).collect()
    assert {(r.array, r.i, r.j): r.value for r in cells if r.array == "c"} == {("c", 0, 0): 1.0, ("c", 0, 1): 2.0, ("c", 1, 0): 3.0, ("c", 1, 1): 4.0}
    assert {r.array for r in cells} == {"a", "sub/z/m", "c"}
    np.save(root / "c.npy", np.ones((1, 1)))
    with pytest.raises(Exception, match="two files of one name"):
        levels.read_fixtures(spark, str(root)).collect()
    (root / "manifest.json").write_text(json.dumps({"labels": {"a": ["x", "y"]}}))
    assert [tuple(r) for r in levels.read_labels(spark, str(root / "manifest.json")).orderBy("ord").collect()] == [("a", 0, "x"), ("a", 1, "y")]
    result = {"kernel": "k", "backend": "numpy", "device": "cpu", "horizon": 4, "repeats": 3, "dtype": "float64", "elapsed_seconds": 0.5, "skipped": False, "available": True}
    for name, command in (("m1", {"draws": "8"}), ("m2", {"draws": "8"})):
        (tmp_path / f"{name}.json").write_text(json.dumps({"command": command, "results": [result]}))
    reports = levels.read_reports(spark, str(tmp_path / "*.json"))
    assert [r.machine for r in compare.bench_rows(reports).collect()] == ["m1", "m2"]
    other = reports.withColumn("command", F.when(F.col("machine") == "m1", F.col("command")).otherwise(F.create_map(F.lit("draws"), F.lit("9"))))
    with pytest.raises(Exception, match="commands of the reports differ"):
        compare.bench_rows(other).collect()
    (tmp_path / "m3.json").write_text(json.dumps({"command": {}, "results": [{"kernel": "k"}]}))
    with pytest.raises(Exception, match="broken report"):
        levels.read_reports(spark, str(tmp_path / "m3.json")).collect()


def test_archives(spark, tmp_path):
    mode = spark.createDataFrame([("a", 1.0)], "parameter string, value double")
    archives.write_archive(mode, str(tmp_path / "m"), "mode", logpost=-3.5)
    df, meta = archives.read_archive(spark, str(tmp_path / "m"), "mode", ["logpost"])
    assert df.collect() == mode.collect() and meta["logpost"] == -3.5
    with pytest.raises(ValueError, match="not a sampler"):
        archives.read_archive(spark, str(tmp_path / "m"), "sampler")
    with pytest.raises(ValueError, match="accepted"):
        archives.write_archive(mode, str(tmp_path / "t"), "trace")
    trace = spark.createDataFrame([("c", 1, -1.0, True), ("c", 1, -1.0, True), ("c", 4, None, True), ("d", 1, 0.0, False)], "chain string, draw int, logpost double, accepted boolean")
    assert [tuple(r) for r in archives.trace_faults(trace).collect()] == [("c", 1, 1, 2)]


def test_population_trend_over_the_tail(spark):
    recorded = [100.0 + i + (i % 3) for i in range(12)]
    tail = [recorded[-1], 113.0, 115.0]  # begins in the last recorded quarter
    v = spark.createDataFrame([(i, x) for i, x in enumerate(recorded)], "quarter_idx int, CNP16OV double")
    f = spark.createDataFrame([(5, 1.0), *((11 + i, x) for i, x in enumerate(tail))], "quarter_idx int, CNP16OV double")
    got = observables.population_helpers(v, "CNP16OV", f).orderBy("quarter_idx").collect()
    y = np.array(recorded + tail)
    d = np.diff(np.eye(len(y)), 2, axis=0)
    want = np.linalg.solve(np.eye(len(y)) + 1600 * d.T @ d, y)[:12]
    assert np.allclose([r[observables.FILTERED] for r in got], want)
    assert got[0].dlpopulation_recorded is None and np.allclose([r.dlfiltered_population_recorded for r in got[1:]], 100 * np.diff(np.log(want)))
    unknown = observables.Observable("x", "no_such_transform")
    with pytest.raises(KeyError, match="no_such_transform"):
        observables.observed(v, [unknown])


def test_contract_slopes_are_those_of_differences():
    z, s, p, e = np.array([-1.2, -2.0]), np.array([0.3, 0.45]), np.array([1.003, 1.006]), 1e-5
    c = frictions.contract(z, s, p)
    up, down = frictions.contract(z + e, s, p), frictions.contract(z - e, s, p)
    by_z = lambda name: (up[name] - down[name]) / (up["omega"] - down["omega"])
    # sigma moves with omega held: z follows
    hold = lambda d: (np.log(c["omega"]) + (s + d) ** 2 / 2) / (s + d)
    more, less = frictions.contract(hold(e), s + e, p), frictions.contract(hold(-e), s - e, p)
    by_s = lambda name: (more[name] - less[name]) / (2 * e)
    for name in ("G", "Gamma"):
        assert np.allclose(c[f"d{name}_domega"], by_z(name), rtol=1e-6)
        assert np.allclose(c[f"d2{name}_domega2"], by_z(f"d{name}_domega"), rtol=1e-5)
        assert np.allclose(c[f"d{name}_dsigma"], by_s(name), rtol=1e-5)
        assert np.allclose(c[f"d2{name}_domega_dsigma"], by_s(f"d{name}_domega"), rtol=1e-5)
    kept = c["Gamma"] - c["mu"] * c["G"]
    assert np.allclose(1 - kept * p, c["nk"]) and np.isfinite(c["zeta_spb"]).all()


def test_bands_of_missing_tied_and_single_values(spark):
    rng = np.random.default_rng(3)
    values = {"many": list(np.round(rng.normal(size=999), 2)), "negative": [-5.0, -5.0, -1.0], "one": [7.0], "none": [None, float("nan")], None: [1.0, 2.0]}
    rows = [(k, None if v is None else float(v)) for k, vs in values.items() for v in vs]
    got = {r.k: r for r in bands.bands(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v").collect()}
    for k, vs in values.items():
        clean = [v for v in vs if v is not None and not np.isnan(v)]
        if not clean:
            assert (got[k]["mean"], got[k].lower, got[k].upper) == (None, None, None)
        else:
            assert np.allclose([got[k]["mean"], got[k].lower, got[k].upper], [np.mean(clean), *np.quantile(clean, [0.05, 0.95])])


def test_checks_that_fail_the_query(spark):
    effects = spark.createDataFrame([(1, 3.0, 1.0, 2.0, 0.5), (2, 3.0, 1.0, 1.0, 0.5)], "q int, headline double, food double, services double, shelter double")
    out = accounting.accounting(effects, "headline", ["food", "services"], {"services": "shelter"})
    assert [(r.residual_ok, r.reconciles) for r in out.orderBy("q").collect()] == [(True, True), (False, True)]
    with pytest.raises(Exception, match="accounting fails"):
        accounting.accounting(effects, "headline", ["food", "services"], {"services": "shelter"}, strict=True).collect()
    with pytest.raises(Exception, match="not symmetric"):
        posterior.proposal_scale(spark.createDataFrame([("k", 0, 1, 1.0), ("k", 1, 0, 2.0)], "key string, i int, j int, value double"), 1.0).collect()
    with pytest.raises(Exception, match="fixed parameter: a"):
        posterior.estimated(spark.createDataFrame([("a", True, "normal")], "name string, fixed boolean, prior string"), ["a"]).collect()
    with pytest.raises(Exception, match="horizons are positive"):
        spark.range(1).select(T.horizons(F.create_map(F.lit("r"), F.array(F.lit(0))), F.array(F.lit(1)))).collect()
    with pytest.raises(Exception, match="too few quarters"):
        ingest.hours_bridge(spark.createDataFrame([(1, i, float(i), float(i * i)) for i in range(9)], "s int, q int, y double, x double"), ["s"], "q", "y", "x", 5, 5).collect()
    with pytest.raises(KeyError):
        frames.requested(effects, ["nothing"])
    assert frames.markdown(effects.select("q").orderBy("q")) == "| q |\n| --- |\n| 1 |\n| 2 |"


def test_long_memory_and_repeated_baselines(spark):
    n = 400
    slow = [(i, float(np.cos(np.pi * i / n))) for i in range(n)]  # positive autocorrelation far beyond twenty lags
    r = diagnostics.effective_size(spark.createDataFrame(slow, "draw int, value double").withColumn("chain", F.lit("c")), ["chain"], "draw", "value").first()
    x = np.array([v for _, v in slow])
    x -= x.mean()
    rho = [x[:-k] @ x[k:] / ((n - k) * (x @ x) / n) for k in range(1, n)]
    stop = next(i for i, v in enumerate(rho) if v <= 0)
    assert stop > 20 and np.isclose(r.iat, 1 + 2 * sum(rho[:stop]))
    results = spark.createDataFrame([("k", 1, 2.0), ("k", 1, 2.0)], "kernel string, horizon int, elapsed double")
    base = spark.createDataFrame([(0, "k", None, 4.0), (1, "k", 1, 8.0)], "ord int, kernel string, horizon int, elapsed double")
    assert [x.baseline for x in compare.matched_baseline(results, base, ["kernel"], ["horizon"]).collect()] == [4.0, 4.0]
