"""NPY and NPZ archives: round trips, and what may not be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartermill.sources import levels, npz


def test_cubes_and_matrices(spark, tmp_path):
    cube = np.random.default_rng(1).normal(size=(5, 3, 2))
    np.save(tmp_path / "a.npy", cube)
    np.savez(tmp_path / "b.npz", shock_samples=cube, other=np.ones(2))
    np.savez(tmp_path / "c.npz", only=cube)
    for name in ("a.npy", "b.npz", "c.npz"):
        got = {(r.draw, r.h, r.shock): r.value for r in npz.read_cube(spark, str(tmp_path / name)).collect()}
        assert got == {k: v for k, v in np.ndenumerate(cube)}
    np.savez(tmp_path / "two.npz", x=cube, y=cube)
    np.save(tmp_path / "flat.npy", cube[0])
    for name, fault in (("two.npz", "one array only"), ("flat.npy", "rank 2")):
        with pytest.raises(Exception, match=fault):
            npz.read_cube(spark, str(tmp_path / name)).collect()
    m = np.array([[2.0, 0.5], [0.5, 1.0]])
    np.savetxt(tmp_path / "m.csv", m, delimiter=",")
    np.savez(tmp_path / "m.npz", proposal_covariance=m, x=np.ones(1))
    for name in ("m.csv", "m.npz"):
        assert {(r.i, r.j): r.value for r in npz.read_matrix(spark, str(tmp_path / name)).collect()} == {k: v for k, v in np.ndenumerate(m)}
    np.save(tmp_path / "skew.npy", np.array([[1.0, 2.0], [0.0, 1.0]]))
    assert npz.read_matrix(spark, str(tmp_path / "skew.npy"), symmetric=False).count() == 4
    with pytest.raises(Exception, match="symmetric"):
        npz.read_matrix(spark, str(tmp_path / "skew.npy")).collect()
    with pytest.raises(ValueError, match="isn't one of"):
        npz.read_matrix(spark, "m.txt")


def test_modes(spark, tmp_path):
    rows = spark.createDataFrame([("rho", 0.5), ("alpha", 1.5)], "parameter string, value double")
    path = str(tmp_path / "mode.npz")
    for hessian, iterations in ((None, None), (np.eye(2), 7)):
        npz.write_mode(rows, path, -3.5, True, "done", iterations, hessian=hessian)
        back, facts = npz.read_mode(spark, path)
        assert [tuple(r) for r in back.collect()] == [("alpha", 1.5), ("rho", 0.5)]
        assert (facts["objective_value"], facts["success"], facts["message"], facts["iterations"], facts["function_evaluations"]) == (-3.5, True, "done", iterations, None)
        assert facts["hessian"] is None if hessian is None else np.allclose(facts["hessian"], np.eye(2))
    for bad in ({"objective_value": np.inf}, {"hessian": np.eye(3)}, {"hessian": np.full((2, 2), np.nan)}):
        with pytest.raises(ValueError):
            npz.write_mode(rows, path, **({"objective_value": 0.0, "success": True} | bad))
    np.savez(tmp_path / "less.npz", parameter_names=np.array(["a"]))
    with pytest.raises(KeyError, match="lacks"):
        npz.read_mode(spark, str(tmp_path / "less.npz"))


def sampler_rows(spark):
    rows = [(d, p, d + k / 10, float(np.exp(d + k / 10)), -float(d), d % 2 == 0) for d in range(6) for k, p in enumerate(("b", "a"))]
    return spark.createDataFrame(rows, "draw long, parameter string, line double, value double, logpost double, accepted boolean")


def test_sampler_runs(spark, tmp_path):
    path, rows = str(tmp_path / "run.npz"), sampler_rows(spark)
    npz.write_sampler(rows, path, np.eye(2), seed=4, burnin=1, mhthin=2, sampling_method="MH", cc=0.3)
    back, facts = npz.read_sampler(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert facts["seed"] == 4 and facts["mhthin"] == 2 and facts["n_blocks"] == 1 and facts["cc"] == 0.3 and facts["sampling_method"] == "MH" and facts["acceptance_rate"] == 0.5 and facts["draws"] == 6
    found = dict(np.load(path))
    # an older archive without the later facts, and texts for truth values
    older = {k: v for k, v in found.items() if k in npz.SAMPLER} | {"mode_in": np.array(["b'True'"]), "seed": np.array([-1])}
    np.savez(tmp_path / "older.npz", **older)
    facts = npz.read_sampler(spark, str(tmp_path / "older.npz"))[1]
    assert facts["mode_in"] is True and facts["seed"] is None and facts["c"] == 0.5
    for change in ({"alpha": np.array([2.0])}, {"n_param_blocks": np.array([3])}, {"accepted": found["accepted"][:2]}, {"proposal_covariance": np.array([[1.0, 2.0], [0.0, 1.0]])}, {"burnin_blocks": np.array([5])}):
        np.savez(tmp_path / "bad.npz", **(found | change))
        with pytest.raises(Exception, match="not so|shapes"):
            npz.read_sampler(spark, str(tmp_path / "bad.npz"))
    with pytest.raises(ValueError, match="every parameter"):
        npz.write_sampler(rows.where("not (draw = 2 and parameter = 'a')"), path, np.eye(2))
    with pytest.raises(KeyError):
        npz.write_sampler(rows, path, np.eye(2), colour="red")


def test_archives_have_a_largest_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(npz, "MAX_VALUES", 10)
    with pytest.raises(ValueError, match="at most 10 values"):
        npz.write_sampler(sampler_rows(spark), str(tmp_path / "run.npz"), np.eye(2))


def test_fixtures_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    made = {"v": rng.normal(size=3), "m": rng.normal(size=(2, 4)), "cube": rng.normal(size=(2, 3, 2))}
    np.savez(tmp_path / "fix.npz", **made)
    cells = levels.read_fixtures(spark, str(tmp_path)).withColumn("array", F.regexp_replace("array", "^fix/", ""))
    out = tmp_path / "again" / "fix.npz"
    npz.write_fixture(cells, str(out), {k: v.shape for k, v in made.items()})
    back = np.load(out)
    assert all(np.array_equal(back[k], v) for k, v in made.items())
    with pytest.raises(ValueError, match="cells for shape"):
        npz.write_fixture(cells, str(out), {"v": (4,)})
