"""The costly-verification contract with lognormal returns: shares, their slopes, and the elasticities that a model needs.

omega is the cut-off return, z its place in standard units, sigma the spread and spr the
premium s. The lender's gross share is Gamma, G what is lost below the cut-off, and K =
Gamma - mu G what the lender keeps; nk is net worth over capital.

The lender breaks even, K s = 1 - nk. The contract is best where (1 - Gamma) s = L (1 - K s)
with L = Gamma' / K', which is linear in the verification cost mu and so gives it from s. Along
that condition 1 / s = (1 - Gamma) / L + K, whose slope in omega is (1 - Gamma) (1 / L)', as the
two other terms cancel; so the premium falls by zeta_bomega = omega mu nk (Gamma'' G' - G''
Gamma') / (K' Gamma') per cent for one of omega, while what the lender keeps rises by
zeta_zomega = omega K' / K. Breaking even ties both to nk, and the premium's elasticity to
leverage, 1 / nk, is zeta_spb = zeta_b / (zeta_b - zeta_z) nk / (1 - nk).
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NAMES = (
    "omega", "G", "Gamma", "dG_domega", "d2G_domega2", "dGamma_domega", "d2Gamma_domega2", "dG_dsigma", "d2G_domega_dsigma", "dGamma_dsigma", "d2Gamma_domega_dsigma",
    "mu", "nk", "zeta_bomega", "zeta_zomega", "zeta_spb",
)


def contract(z: np.ndarray, sigma: np.ndarray, spr: np.ndarray) -> dict[str, np.ndarray]:
    """All sixteen quantities of many contracts at once."""
    below = lambda x: 0.5 * (1 + np.array([erf(v / sqrt(2)) for v in x]))
    density = lambda x: np.exp(-0.5 * x * x) / np.sqrt(2 * np.pi)
    f, shifted = density(z), density(z - sigma)
    above = 1 - below(z)
    out = {"omega": np.exp(sigma * (z - sigma / 2)), "G": below(z - sigma)}
    w, g = out["omega"], out["G"]
    out |= {"Gamma": w * above + g, "dG_domega": f / sigma, "d2G_domega2": -z * f / (w * sigma**2), "dGamma_domega": above, "d2Gamma_domega2": -f / (w * sigma)}
    out |= {"dG_dsigma": -z * shifted / sigma, "d2G_domega_dsigma": f * (z * (z - sigma) - 1) / sigma**2, "dGamma_dsigma": -shifted, "d2Gamma_domega_dsigma": f * (z - sigma) / sigma}
    share, slope, loss = out["Gamma"], out["dGamma_domega"], out["dG_domega"]
    mu = (1 - 1 / spr) / (g + loss_by_share(out))
    keeps, keeps_slope = share - mu * g, slope - mu * loss
    nk = 1 - keeps * spr
    falls = w * mu * nk * (out["d2Gamma_domega2"] * loss - out["d2G_domega2"] * slope) / (keeps_slope * slope)
    rises = w * keeps_slope / keeps
    return out | {"mu": mu, "nk": nk, "zeta_bomega": falls, "zeta_zomega": rises, "zeta_spb": falls / (falls - rises) * nk / (1 - nk)}


def loss_by_share(out: dict[str, np.ndarray]) -> np.ndarray:
    """What a cut-off's rise loses for what it moves to the lender, of all that the borrower still has."""
    return out["dG_domega"] * (1 - out["Gamma"]) / out["dGamma_domega"]


def contracts(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, z, sigma, spr) with the sixteen quantities."""

    def run(parts):
        for pdf in parts:
            z, sigma, spr = (pdf[c].to_numpy(float) for c in ("z", "sigma", "spr"))
            yield pd.DataFrame({key: pdf[key], **contract(z, sigma, spr)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "z", "sigma", "spr").mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in NAMES))
