"""NPY and NPZ archives of cubes, matrices, modes and sampler runs: read by tasks as long tables, written from tables of checked size.

What tools outside Spark exchange; archives.py has the form for tables of any size.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An archive is written from the driver: values that it may hold.
MAX_VALUES = 20_000_000

#: Arrays of a mode's and of a sampler run's archive, and what a run's archive may leave out.
MODE = ("parameter_names", "estimation_values", "objective_value", "success", "message", "iterations", "function_evaluations", "hessian_present", "hessian")
SAMPLER = ("parameter_names", "estimation_draws", "parameter_draws", "log_posterior", "accepted", "acceptance_rate", "proposal_covariance", "seed", "burnin")
SAMPLER_DEFAULTS = {"n_blocks": 1, "n_param_blocks": 1, "mhthin": 1, "burnin_blocks": 0, "proposal_scale": 1.0, "adaptive_accept": False, "target_accept": 0.25, "alpha": 1.0, "c": 0.5}
SAMPLER_OPTIONAL = {"sampling_method": str, "mode_in": bool, "hessian_in": bool, "calculate_hessian": bool, "reoptimize": bool, "run_csminwel": bool, "cc": float, "cc0": float}

Check = tuple[str, Callable[[dict], bool]]
#: What a sampler run's facts must be, beyond the arrays' shapes.
SAMPLER_RULES: tuple[Check, ...] = (
    ("proposal_scale is positive", lambda m: 0 < m["proposal_scale"] < np.inf),
    ("n_blocks, n_param_blocks and mhthin are positive", lambda m: min(m["n_blocks"], m["n_param_blocks"], m["mhthin"]) >= 1),
    ("n_param_blocks is at most the number of parameters", lambda m: m["n_param_blocks"] <= len(m["parameter_names"])),
    ("burnin_blocks lies between 0 and n_blocks", lambda m: 0 <= m["burnin_blocks"] <= m["n_blocks"]),
    ("target_accept lies between 0 and 1", lambda m: not m["adaptive_accept"] or 0 <= m["target_accept"] <= 1),
    ("alpha lies between 0 and 1", lambda m: 0 <= m["alpha"] <= 1),
    ("c is positive", lambda m: m["c"] > 0),
    ("acceptance_rate lies between 0 and 1", lambda m: 0 <= m["acceptance_rate"] <= 1),
    ("burnin is at least 0", lambda m: m["burnin"] >= 0),
    ("cc and cc0 are finite", lambda m: all(m.get(k) is None or np.isfinite(m[k]) for k in ("cc", "cc0"))),
)
MODE_RULES: tuple[Check, ...] = (
    ("objective_value is finite", lambda m: bool(np.isfinite(m["objective_value"]))),
    ("values are finite", lambda m: bool(np.isfinite(m["values"]).all())),
    ("the Hessian is finite", lambda m: m["hessian"] is None or bool(np.isfinite(m["hessian"]).all())),
)


def checked(facts: dict, rules: Sequence[Check]) -> dict:
    if broken := [text for text, holds in rules if not holds(facts)]:
        raise ValueError(f"not so: {'; '.join(broken)}")
    return facts


def arrays_in(content: bytes, kind: str) -> dict[str, np.ndarray]:
    """The arrays of a file's bytes by name; CSV and NPY have one without a name."""
    if kind == "csv":
        return {"": np.loadtxt(io.BytesIO(content), delimiter=",", ndmin=2)}
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    return {"": loaded} if isinstance(loaded, np.ndarray) else {k: loaded[k] for k in loaded.files}


def chosen(arrays: dict[str, np.ndarray], name: str) -> np.ndarray:
    """The named array, else the only one."""
    if name not in arrays and len(arrays) != 1:
        raise ValueError(f"an archive has {name} or one array only, not {sorted(arrays)}")
    return np.asarray(arrays.get(name, next(iter(arrays.values()))), float)


def _file(spark: SparkSession, path: str, kinds: Sequence[str]) -> tuple[DataFrame, str]:
    kind = path.rpartition(".")[2].lower()
    if kind not in kinds:
        raise ValueError(f"{path} isn't one of {list(kinds)}")
    return spark.read.format("binaryFile").load(path).select("content"), kind


def read_cube(spark: SparkSession, path: str, name: str = "shock_samples") -> DataFrame:
    """(draw, h, shock, value) of an array of rank 3; another rank fails the query."""
    file, kind = _file(spark, path, ("npy", "npz"))

    def run(parts):
        for pdf in parts:
            for content in pdf["content"]:
                cube = chosen(arrays_in(content, kind), name)
                if cube.ndim != 3:
                    raise ValueError(f"{path}: rank {cube.ndim}, not 3")
                step = max(1, 1_000_000 // max(1, cube[0].size if len(cube) else 1))
                for first in range(0, len(cube), step):  # a part of the draws at a time
                    d, h, s = np.indices(cube[first : first + step].shape)
                    yield pd.DataFrame({"draw": d.ravel() + first, "h": h.ravel(), "shock": s.ravel(), "value": cube[first : first + step].ravel()})

    return file.mapInPandas(run, "draw long, h int, shock int, value double")


def read_matrix(spark: SparkSession, path: str, name: str = "proposal_covariance", symmetric: bool = True) -> DataFrame:
    """(i, j, value) of a square matrix of finite numbers; one that isn't so, or isn't symmetric where it must be, fails the query."""
    file, kind = _file(spark, path, ("csv", "npy", "npz"))

    def run(parts):
        for pdf in parts:
            for content in pdf["content"]:
                m = np.atleast_2d(chosen(arrays_in(content, kind), name))
                if m.ndim != 2 or m.shape[0] != m.shape[1] or not np.isfinite(m).all() or (symmetric and not np.allclose(m, m.T)):
                    raise ValueError(f"{path}: not a square{' symmetric' if symmetric else ''} matrix of finite numbers")
                i, j = np.indices(m.shape)
                yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": m.ravel()})

    return file.mapInPandas(run, "i int, j int, value double")


def _named(content: bytes, needed: Sequence[str], path: str) -> dict[str, np.ndarray]:
    found = arrays_in(content, "npz")
    if lacking := [n for n in needed if n not in found]:
        raise KeyError(f"{path} lacks {lacking}")
    return found


def _one(a: np.ndarray):
    return np.ravel(a)[0].item()


def loose(value, kind: type):
    """A scalar that tools have written as a number, a truth value or their text; None for what isn't one."""
    text = str(value).strip().strip("b'\"").lower()
    if kind is str:
        return str(value) if text else None
    if kind is bool:
        return True if text in ("true", "1", "1.0") else False if text in ("false", "0", "0.0") else None
    try:
        return float(text)
    except ValueError:
        return None


def read_mode(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A mode's archive: (parameter, value) and its facts, the Hessian among them; a mode is a model's parameters in size."""
    file, _ = _file(spark, path, ("npz",))
    found = _named(bytes(file.first().content), MODE, path)
    names, values = [str(n) for n in found["parameter_names"]], np.asarray(found["estimation_values"], float)
    hessian = np.asarray(found["hessian"], float) if _one(found["hessian_present"]) else None
    if not names or values.shape != (len(names),) or (hessian is not None and hessian.shape != (len(names),) * 2):
        raise ValueError(f"{path}: shapes don't fit {len(names)} parameters")
    counts = {k: None if _one(found[k]) < 0 else _one(found[k]) for k in ("iterations", "function_evaluations")}
    facts = {"objective_value": _one(found["objective_value"]), "success": bool(_one(found["success"])), "message": str(_one(found["message"])), **counts, "hessian": hessian, "values": values}
    checked(facts, MODE_RULES)
    return spark.createDataFrame(list(zip(names, values.tolist())), "parameter string, value double"), {k: v for k, v in facts.items() if k != "values"}


def read_sampler(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A sampler run's archive: (draw, parameter, line, value, logpost, accepted), read by a task, and its facts; a seed below 0 is none."""
    file, _ = _file(spark, path, ("npz",))

    def facts_of(content: bytes) -> dict:
        found = _named(content, SAMPLER, path)
        names = [str(n) for n in found["parameter_names"]]
        n, shape = len(found["log_posterior"]), (len(found["log_posterior"]), len(names))
        cov = np.asarray(found["proposal_covariance"], float)
        if not names or any(found[k].shape != shape for k in ("estimation_draws", "parameter_draws")) or found["accepted"].shape != (n,) or cov.shape != (len(names),) * 2 or not np.allclose(cov, cov.T):
            raise ValueError(f"{path}: shapes don't fit {n} draws of {len(names)} parameters, or the covariance isn't symmetric")
        facts = {"parameter_names": names, "draws": n, "proposal_covariance": cov.tolist(), **{k: _one(found[k]) for k in ("acceptance_rate", "burnin", "seed")}}
        facts |= {k: type(v)(_one(found[k])) if k in found else v for k, v in SAMPLER_DEFAULTS.items()}
        facts |= {k: loose(np.ravel(found[k])[0], kind) for k, kind in SAMPLER_OPTIONAL.items() if k in found}
        return checked(facts | {"seed": None if facts["seed"] < 0 else facts["seed"]}, SAMPLER_RULES)

    def run(parts):
        for pdf in parts:
            for content in pdf["content"]:
                names, found = facts_of(content)["parameter_names"], arrays_in(content, "npz")
                for first in range(0, len(found["accepted"]), 10_000):
                    part = slice(first, first + 10_000)
                    d, p = np.indices(found["parameter_draws"][part].shape)
                    d = d.ravel()
                    yield pd.DataFrame({"draw": d + first, "parameter": np.array(names, object)[p.ravel()], "line": found["estimation_draws"][part].ravel(), "value": found["parameter_draws"][part].ravel(), "logpost": found["log_posterior"][part][d], "accepted": found["accepted"][part].astype(bool)[d]})

    import json

    facts = file.mapInPandas(lambda parts: (pd.DataFrame({"facts": [json.dumps(facts_of(c)) for c in pdf["content"]]}) for pdf in parts), "facts string").first().facts
    return file.mapInPandas(run, "draw long, parameter string, line double, value double, logpost double, accepted boolean"), json.loads(facts)


def write_npz(spark: SparkSession, path: str, **arrays: np.ndarray) -> None:
    """Arrays as one NPZ file, on any file system that Spark writes to."""
    if not path.endswith(".npz"):
        raise ValueError(f"{path} isn't an NPZ archive")
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(buffer.getvalue()))
    finally:
        out.close()


def _limited(df: DataFrame, per_row: int) -> pd.DataFrame:
    most = MAX_VALUES // max(1, per_row)
    if df.limit(most + 1).count() > most:
        raise ValueError(f"an archive has at most {MAX_VALUES} values: keep larger ones as Parquet (archives.py)")
    return df.toPandas()


def write_mode(values: DataFrame, path: str, objective_value: float, success: bool, message: str = "", iterations: int | None = None, function_evaluations: int | None = None, hessian: np.ndarray | None = None) -> None:
    """(parameter, value) and a mode's facts as an archive; parameters by name."""
    rows = _limited(values.select("parameter", "value"), 2).sort_values("parameter")
    x = rows["value"].to_numpy(float)
    if not len(x) or (hessian is not None and hessian.shape != (len(x),) * 2):
        raise ValueError("a mode has parameters, and a Hessian of their number")
    checked({"objective_value": objective_value, "values": x, "hessian": hessian}, MODE_RULES)
    counts = {k: np.array([-1 if v is None else v]) for k, v in (("iterations", iterations), ("function_evaluations", function_evaluations))}
    write_npz(values.sparkSession, path, parameter_names=rows["parameter"].to_numpy(str), estimation_values=x, objective_value=np.array([float(objective_value)]), success=np.array([bool(success)]), message=np.array([message], str), hessian_present=np.array([hessian is not None]), hessian=np.empty((0, 0)) if hessian is None else hessian, **counts)


def write_sampler(draws: DataFrame, path: str, proposal_covariance: np.ndarray, seed: int | None = None, burnin: int = 0, **facts) -> None:
    """(draw, parameter, line, value, logpost, accepted) and a run's facts as an archive; draws in order, parameters by name."""
    if unknown := [k for k in facts if k not in SAMPLER_DEFAULTS and k not in SAMPLER_OPTIONAL]:
        raise KeyError(f"unknown facts: {unknown}")
    rows = _limited(draws.select("draw", "parameter", "line", "value", "logpost", "accepted"), 3)
    wide = rows.pivot(index="draw", columns="parameter", values=["line", "value"]).sort_index()
    names = sorted(set(rows["parameter"]))
    if wide.isna().any(axis=None) or proposal_covariance.shape != (len(names),) * 2 or not np.allclose(proposal_covariance, proposal_covariance.T):
        raise ValueError("every draw has every parameter, and the covariance is symmetric and of their number")
    per = rows.drop_duplicates("draw").sort_values("draw")
    all_facts = {**SAMPLER_DEFAULTS, **facts}
    checked({**all_facts, "parameter_names": names, "acceptance_rate": float(per["accepted"].mean()), "burnin": burnin}, SAMPLER_RULES)
    write_npz(
        draws.sparkSession, path, parameter_names=np.array(names, str), estimation_draws=wide["line"][names].to_numpy(float), parameter_draws=wide["value"][names].to_numpy(float), log_posterior=per["logpost"].to_numpy(float),
        accepted=per["accepted"].to_numpy(bool), acceptance_rate=np.array([float(per["accepted"].mean())]), proposal_covariance=proposal_covariance, seed=np.array([-1 if seed is None else seed]), burnin=np.array([burnin]), **{k: np.array([v]) for k, v in all_facts.items() if v is not None},
    )


def write_fixture(cells: DataFrame, path: str, shapes: dict[str, tuple[int, ...]]) -> None:
    """Arrays (array, i, j, value) of the given shapes as one archive; a shape whose cells aren't all there fails."""
    rows = _limited(cells.select("array", "i", "j", F.col("value").cast("double").alias("value")), 1)
    out = {}
    for name, shape in shapes.items():
        part = rows[rows["array"] == name]
        flat = np.full((shape[0] if len(shape) > 1 else 1, int(np.prod(shape[1:])) if len(shape) > 1 else shape[0]), np.nan)
        if len(part) != flat.size or (part["i"] >= flat.shape[0]).any() or (part["j"] >= flat.shape[1]).any():
            raise ValueError(f"{name}: {len(part)} cells for shape {shape}")
        flat[part["i"], part["j"]] = part["value"]
        out[name] = flat.reshape(shape)
    write_npz(cells.sparkSession, path, **out)
