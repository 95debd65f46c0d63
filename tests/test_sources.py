"""Sources, checks and edge cases on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from quartermill.functions import transforms as T
from quartermill.functions.quarters import parse_quarter, quarter_label
from quartermill.operators import compare, diagnostics, ingest
from quartermill.sources import tables, vintages


def test_series_file(spark, tmp_path):
    p = tmp_path / "gdp.csv"
    p.write_text("DATE,GDP\n2016-01-01,10\n2016-02-01,20\n2016-03-01,.\nbad,5\n2016-04-01,40\n")
    df = vintages.read_series_csv(spark, str(p), "GDP")
    q = {r.quarter_idx: r.value for r in ingest.quarterly(df, ["mnemonic"], "obs_date", "value").collect()}
    assert q == {2016 * 4 + 1: 15.0, 2016 * 4 + 2: 40.0}
    last = {r.quarter_idx: r.value for r in ingest.quarterly(df, ["mnemonic"], "obs_date", "value", "last").collect()}
    assert last[2016 * 4 + 1] == 20.0


def test_payload_revisions_and_wide_vintages(spark):
    rows = [
        {"observations": [{"date": "2016-07-01", "value": "1", "realtime_start": "2016-10-01"}, {"date": "2016-07-01", "value": "3", "realtime_start": "2016-12-01"}]},
        {"observations": [{"date": "2016-10-01", "GDP_20170101": "4", "_GDP_20170301": "5", "GDP_20180101": "."}]},
        {"error_code": 400, "error_message": "The series does not exist in ALFRED"},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "p string")
    got = ingest.latest_revision(vintages.parse_observations(df, "p", "GDP"), ["obs_date"], "realtime_start")
    assert {str(r.obs_date): r.value for r in got.collect()} == {"2016-07-01": 3.0, "2016-10-01": None}  # the newest vintage counts, missing or not
    assert [r.optional for r in vintages.payload_errors(df, "p").collect()] == [True]


def test_quarters(spark):
    df = spark.createDataFrame([("2016-Q3",), ("2016-Q7",), ("2016-11-30",), ("x",)], "t string")
    got = [tuple(r) for r in df.select(parse_quarter("t").alias("q")).select("q", quarter_label("q")).collect()]
    assert got == [(8067, "2016-Q3"), (None, None), (8068, "2016-Q4"), (None, None)]


def test_coverage_and_ragged_edges(spark):
    long = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0), ("b", 1, None), ("b", 2, 5.0)], "name string, quarter_idx int, value double")
    grid = ingest.quarter_grid(spark, 1, 3)
    assert sorted(map(tuple, ingest.value_coverage(grid, long).collect())) == [("a", 2), ("b", 1), ("b", 3)]
    assert {r.name: r.interior_nulls for r in ingest.ragged(long).collect()} == {"a": 1, "b": 0}
    assert {r.name: r.status for r in ingest.quality_report(long, 3).collect()} == {"a": "ok", "b": "missing at end"}
    with pytest.raises(Exception, match="repeated keys: 1"):
        ingest.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()
    assert ingest.require_unique(long, ["name", "quarter_idx"]).columns == long.columns
    with pytest.raises(ingest.CoverageError):
        ingest.with_optional(long, ["absent"], [])


def test_names_and_requirements(spark):
    names = spark.createDataFrame([("GDP", 1), ("PCE__bea", 2), ("GDP__FRED", 3)], "n string, ord int")
    assert sorted(map(tuple, vintages.source_of(names, "n", "FRED").collect())) == [("BEA", "PCE", 2), ("FRED", "GDP", 1)]
    assert vintages.candidate_names("Fred", "160101")[:2] == ["fred_160101.csv", "FRED_160101.csv"]


def test_unknown_transform_raises(spark):
    with pytest.raises(Exception, match="unknown transform"):
        spark.range(1).select(T.by_name(F.lit("nonesuch"), F.lit(1.0))).collect()


def test_logs_and_ratios_of_nothing(spark):
    row = spark.range(1).select(T.safe_log(F.lit(0.0)), T.safe_log(F.lit(-1.0)), T.ratio(F.lit(1.0), F.lit(0.0)), T.missing_as_null(F.lit(float("nan")))).first()
    assert list(row) == [None] * 4


def test_config(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"horizon": 3, "policy_scenarios": [{"name": "baseline", "label": "x", "rate_deviation_pp": [1, 1, 1, 1]}], "structural_scenarios": [{"name": "baseline", "label": "y", "components": [{"shock": "a", "size_sd": 2.0, "start": 0, "duration": 3, "decay": 0.5}]}]}))
    config = tables.read_config(spark, str(p))
    assert tables.config_faults(config) == ["horizon is under 4", "scenario names repeat", "a scenario is called baseline", "a rate path is longer than the horizon"]
    assert tables.config_components(config).count() == 1 and len(config.first().sha256) == 64


def test_arrays_round_trip_and_compare(spark, tmp_path):
    a = spark.createDataFrame([("x", 0, 0, 1.0), ("x", 0, 1, None), ("y", 0, 0, 2.0)], "array string, i int, j int, value double")
    tables.write_arrays(a, str(tmp_path / "a"))
    b = tables.read_arrays(spark, str(tmp_path / "a"))
    assert all(r.passed for r in compare.compare_arrays(a, b, ["i", "j"], 0, 0).collect())
    moved = a.withColumn("value", F.when(F.col("array") == "y", F.col("value") + 1).otherwise(F.col("value")))
    assert {r.array: (r.passed, r.worst_at) for r in compare.compare_arrays(moved, b, ["i", "j"], 1e-3, 0).collect()}["y"] == (False, "0,0")


def test_tolerance_scales_with_the_actual_value_and_shapes_come_first(spark):
    frame = lambda rows: spark.createDataFrame(rows, "array string, i int, value double")
    inf, nan = float("inf"), float("nan")
    actual = frame([("near", 0, 1.0), ("far", 0, 2.0), ("hole", 0, 1.0), ("hole", 1, nan), ("shape", 0, 1.0), ("ends", 0, inf), ("ends", 1, None), ("signs", 0, inf)])
    desired = frame([("near", 0, 2.0), ("far", 0, 1.0), ("hole", 0, 1.0), ("hole", 1, 3.0), ("shape", 0, 1.0), ("shape", 1, 1.0), ("ends", 0, inf), ("ends", 1, nan), ("signs", 0, -inf)])
    got = {r.array: (r.status, r.max_abs, r.max_rel) for r in compare.compare_arrays(actual, desired, ["i"], 0.5, 0).collect()}
    assert got == {"near": ("failed", 1.0, 0.5), "far": ("passed", 1.0, 1.0), "hole": ("failed", inf, inf), "shape": ("shape_mismatch", None, None), "ends": ("passed", 0.0, 0.0), "signs": ("failed", inf, inf)}
    assert compare.tolerance("Forecast") == (1e-8, 1e-8) and compare.tolerance("strict", rtol=0.5) == (1e-10, 0.5)
    for bad in (("nothing",), ("strict", -1.0)):
        with pytest.raises(ValueError):
            compare.tolerance(*bad)


def test_chain_diagnostics_of_constant_and_short_chains(spark):
    df = spark.createDataFrame([("c", i, 1.0) for i in range(6)] + [("s", i, float(i)) for i in range(3)], "chain string, draw int, value double")
    assert {r.chain: r.rhat for r in diagnostics.split_rhat(df, ["chain"], "draw", "value").collect()} == {"c": 1.0, "s": None}
    assert {r.chain: r.ess for r in diagnostics.effective_size(df, ["chain"], "draw", "value").collect()}["c"] == 6.0
