"""Models as tables: every coefficient of a system's equations is a row, an expression of parameters.

A table (matrix, row, column, expression) states g0 s = g1 s(-1) + c + psi e + pi eta and
y = z s + d + u with covariances q of e and eps of u; cells that aren't stated are 0. Named
expressions, in order, are parameters that follow from others, a steady state's values among
them; a named root is found row by row. A model is checked and compiled once and evaluated
for whole batches of parameter rows, so that systems cost no Python per cell and row.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frictions import contract
from .likelihood import Systems
from .schur import solved_many

FUNCTIONS = {"exp": np.exp, "log": np.log, "sqrt": np.sqrt, "abs": np.abs, "minimum": np.minimum, "maximum": np.maximum, "premium_elasticity": lambda z, sigma, spr: contract(*np.broadcast_arrays(np.asarray(z, float), sigma, spr))["zeta_spb"]}
ARITHMETIC = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow, ast.USub, ast.UAdd, ast.Call, ast.Name, ast.Load, ast.Constant)
#: matrix -> what its rows and columns count
MATRICES = {"g0": ("states", "states"), "g1": ("states", "states"), "c": ("states", ""), "psi": ("states", "shocks"), "pi": ("states", "errors"), "z": ("observables", "states"), "d": ("observables", ""), "q": ("shocks", "shocks"), "eps": ("observables", "observables")}
#: A model's table is collected to the driver and sent with tasks: rows it may have.
MAX_CELLS = 100_000
#: Tasks a core that parameter rows are dealt to.
SPREAD = 2
#: No solution was tried: a coefficient isn't finite.
NOT_FINITE = (-4, -4)


@lru_cache(maxsize=4096)
def compiled(expression: str) -> tuple:
    """Code and names of an arithmetic expression; anything but arithmetic and FUNCTIONS is refused."""
    tree = ast.parse(expression.strip(), mode="eval")
    calls = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    names = set()
    for n in ast.walk(tree):
        sound = isinstance(n, ARITHMETIC) and not getattr(n, "keywords", None)
        if isinstance(n, ast.Constant):
            sound = type(n.value) in (int, float)
        elif isinstance(n, ast.Call):
            sound = sound and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS
        elif isinstance(n, ast.Name) and id(n) not in calls:
            names.add(n.id)
        if not sound:
            raise ValueError(f"not an expression of parameters: {expression}")
    return compile(tree, "<equation>", "eval"), frozenset(names)


def value_of(expression: str, at: dict) -> np.ndarray:
    with np.errstate(all="ignore"):
        return eval(compiled(expression)[0], {"__builtins__": {}}, FUNCTIONS | at)  # checked when compiled


@dataclass(frozen=True)
class Root:
    """A parameter found row by row: where expression, of the parameter's name and others, is 0 between low and high; otherwise `fallback`."""

    name: str
    expression: str
    low: str
    high: str
    fallback: float = float("nan")


@dataclass(frozen=True)
class Model:
    sizes: dict[str, int]
    cells: tuple[tuple[str, int, int, str], ...]
    parameters: tuple[str, ...]
    named: tuple[tuple[str, str] | Root, ...] = field(default=())

    def __post_init__(self):
        known = set(self.parameters)
        for n in self.named:
            texts, name = ([n.expression, n.low, n.high], n.name) if isinstance(n, Root) else ([n[1]], n[0])
            self._check(texts, known | ({name} if isinstance(n, Root) else set()))
            if name in known or name in FUNCTIONS:
                raise ValueError(f"named twice: {name}")
            known.add(name)
        seen = set()
        for matrix, i, j, text in self.cells:
            if matrix not in MATRICES or not (0 <= i < self._size(MATRICES[matrix][0]) and 0 <= j < self._size(MATRICES[matrix][1])) or (matrix, i, j) in seen:
                raise ValueError(f"no such cell, or stated twice: {matrix} {i} {j}")
            seen.add((matrix, i, j))
            self._check([text], known)

    def _size(self, what: str) -> int:
        return self.sizes.get(what, 0) if what else 1

    @staticmethod
    def _check(texts: Sequence[str], known: set[str]) -> None:
        for text in texts:
            if unknown := compiled(text)[1] - known:
                raise ValueError(f"unknown parameters: {sorted(unknown)}")

    def values(self, given: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Parameters and all that is named, one value a row; values out of an expression's domain aren't finite."""
        at = {p: np.asarray(given[p], float) for p in self.parameters}
        rows = len(next(iter(at.values()), ()))
        for n in self.named:
            name, found = (n.name, roots(n, at, rows)) if isinstance(n, Root) else (n[0], value_of(n[1], at))
            at[name] = np.broadcast_to(np.asarray(found, float), (rows,))
        return at

    def matrices(self, at: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Every matrix for every row of parameter values: leading axis rows."""
        rows = len(next(iter(at.values()), ()))
        out = {m: np.zeros((rows, self._size(i), self._size(j))) for m, (i, j) in MATRICES.items()}
        for matrix, i, j, text in self.cells:
            out[matrix][:, i, j] = value_of(text, at)
        return out | {m: out[m][:, :, 0] for m in ("c", "d")}

    def systems(self, at: dict[str, np.ndarray], method: str = "auto") -> tuple[Systems, np.ndarray]:
        """Solved systems of all rows, and their codes; rows without a solution hold zeros."""
        m = self.matrices(at)
        rows, n = m["c"].shape
        t, r, c = np.zeros((rows, n, n)), np.zeros_like(m["psi"]), np.zeros((rows, n))
        codes = np.tile(NOT_FINITE, (rows, 1))
        finite = np.flatnonzero(np.all([np.isfinite(x).reshape(rows, -1).all(axis=1) for x in m.values()], axis=0))
        found = solved_many(*(m[x][finite] for x in ("g0", "g1", "c", "psi", "pi")), method)
        codes[finite] = found.codes
        good = found.codes[:, 0] >= 0
        for x, y in ((t, found.t), (r, found.r), (c, found.c)):
            x[finite[good]] = y[good]
        return Systems(t, r, c, m["q"], m["z"], m["d"], m["eps"]), codes


def roots(root: Root, at: dict[str, np.ndarray], rows: int, turns: int = 200, tolerance: float = 1e-13) -> np.ndarray:
    """The root of every row at once: secant steps that stay within a bracket, halves of it where they don't shrink it; fallback without a bracket."""
    ends = [np.broadcast_to(np.asarray(value_of(x, at), float), (rows,)).copy() for x in (root.low, root.high)]

    def f(x: np.ndarray) -> np.ndarray:
        return np.broadcast_to(np.asarray(value_of(root.expression, at | {root.name: x}), float), (rows,))

    (a, b), (fa, fb) = ends, map(f, ends)
    fa, fb = fa.copy(), fb.copy()
    with np.errstate(all="ignore"):
        sound = np.isfinite(fa) & np.isfinite(fb) & (np.sign(fa) * np.sign(fb) <= 0)
        for turn in range(turns):
            x = np.where(turn % 3 == 2, (a + b) / 2, b - fb * (b - a) / (fb - fa))
            x = np.where(np.isfinite(x) & (x > np.minimum(a, b)) & (x < np.maximum(a, b)), x, (a + b) / 2)
            fx = f(x)
            sound &= np.isfinite(fx)
            left = np.sign(fx) == np.sign(fa)
            a, fa, b, fb = np.where(left, x, a), np.where(left, fx, fa), np.where(left, b, x), np.where(left, fb, fx)
            if (~sound | (fx == 0) | (np.abs(b - a) <= tolerance * np.maximum(1, np.abs(x)))).all():
                break
    return np.where(sound, np.where(np.abs(fa) < np.abs(fb), a, b), root.fallback)


def model_of(table: DataFrame, sizes: dict[str, int], parameters: Sequence[str], named: Sequence[tuple[str, str] | Root] = ()) -> Model:
    """A model from its table of cells (matrix, row, column, expression), whose size is checked before it is collected."""
    cells = table.select("matrix", F.col("row").cast("int"), F.col("column").cast("int"), "expression")
    if cells.limit(MAX_CELLS + 1).count() > MAX_CELLS:
        raise ValueError(f"a model has at most {MAX_CELLS} cells")
    return Model(dict(sizes), tuple(sorted(tuple(r) for r in cells.collect())), tuple(parameters), tuple(named))


def per_batch(rows: DataFrame, model: Model, keep: Sequence[str], schema: str, work: Callable[[pd.DataFrame, dict], pd.DataFrame]) -> DataFrame:
    """work(kept columns, parameter values) over Arrow batches of parameter rows."""

    def run(parts):
        for pdf in parts:
            if len(pdf):
                yield work(pdf, model.values({p: pdf[p].to_numpy(float) for p in model.parameters}))

    return spread(rows.select(*keep, *[F.col(p).cast("double").alias(p) for p in model.parameters if p not in keep])).mapInPandas(run, schema)


def spread(rows: DataFrame) -> DataFrame:
    """Parameter rows dealt evenly to all cores: they are narrow, so that one file, or one task's share of it, holds far more of them than one task should work on."""
    return rows.repartition(SPREAD * rows.sparkSession.sparkContext.defaultParallelism)


def kinds(rows: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


def solutions(rows: DataFrame, keys: Sequence[str], model: Model, method: str = "auto") -> DataFrame:
    """keys, the codes `exists` and `unique`, and t, r, c row by row (null below code 0) of every parameter row's system."""

    def work(pdf: pd.DataFrame, at: dict) -> pd.DataFrame:
        s, codes = model.systems(at, method)
        out = pdf[list(keys)].assign(exists=codes[:, 0].astype("int32"), unique=codes[:, 1].astype("int32"))
        for name, x in (("t", s.T), ("r", s.R), ("c", s.C)):
            out[name] = [x[k].ravel() if codes[k, 0] >= 0 else None for k in range(len(pdf))]
        return out

    return per_batch(rows, model, keys, f"{kinds(rows, keys)}, exists int, unique int, t array<double>, r array<double>, c array<double>", work)


def named_values(rows: DataFrame, keys: Sequence[str], model: Model, names: Sequence[str]) -> DataFrame:
    """keys and the named parameters' values of every row; null where they aren't finite."""

    def work(pdf: pd.DataFrame, at: dict) -> pd.DataFrame:
        return pdf[list(keys)].assign(**{n: at[n] for n in names})

    out = per_batch(rows, model, keys, f"{kinds(rows, keys)}, {', '.join(f'`{n}` double' for n in names)}", work)
    return out.select(*keys, *[F.when(F.abs(F.col(n)) < F.lit(float("inf")), F.col(n)).alias(n) for n in names])


def cells(rows: DataFrame, keys: Sequence[str], model: Model) -> DataFrame:
    """The model's coefficients for every parameter row, sparse and long: keys, matrix, row, column, value."""

    def work(pdf: pd.DataFrame, at: dict) -> pd.DataFrame:
        m = model.matrices(at)
        parts = [pdf[list(keys)].assign(matrix=x, row=np.int32(i), column=np.int32(j), value=m[x][:, i] if m[x].ndim == 2 else m[x][:, i, j]) for x, i, j, _ in model.cells]
        return pd.concat(parts) if parts else pdf[list(keys)].iloc[:0].assign(matrix="", row=np.int32(0), column=np.int32(0), value=0.0)

    return per_batch(rows, model, keys, f"{kinds(rows, keys)}, matrix string, row int, column int, value double", work)


def log_likelihoods(rows: DataFrame, keys: Sequence[str], model: Model, data: np.ndarray, method: str = "auto", count_from: int = 0) -> DataFrame:
    """keys, codes and the Kalman log likelihood of `data` (periods x observables) for every parameter row; minus infinity without the one stable solution."""

    def work(pdf: pd.DataFrame, at: dict) -> pd.DataFrame:
        codes, loglik = likelihoods(model, at, data, method, count_from)
        return pdf[list(keys)].assign(exists=codes[:, 0].astype("int32"), unique=codes[:, 1].astype("int32"), loglik=loglik)

    return per_batch(rows, model, keys, f"{kinds(rows, keys)}, exists int, unique int, loglik double", work)


def likelihoods(model: Model, at: dict, data: np.ndarray, method: str = "auto", count_from: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Codes and log likelihoods of parameter values, one a row."""
    s, codes = model.systems(at, method)
    good = (codes == 1).all(axis=1)
    loglik = np.full(len(codes), -np.inf)
    loglik[good] = s.rows(good).loglik(data, count_from=count_from)
    return codes, loglik
