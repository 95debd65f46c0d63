"""Models stated as tables: solver codes, steady states, posteriors, optimisers and chains over rows of given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import transforms as T
from ..plans import equations, estimation
from ..plans.equations import Model, Root
from ..plans.likelihood import collected
from .kernels import BASE, observed
from .registry import query, table

#: A rate rule i = phi (p - pstar) + pstar, the real rate r = i - E p(+1) with r = rho r(-1) + e; states p, E p(+1), r.
RULE = (
    ("g0", 0, 0, "phi"), ("g0", 0, 1, "-1"), ("g0", 0, 2, "-1"), ("g0", 1, 0, "1"), ("g0", 2, 2, "live"),
    ("g1", 1, 1, "1"), ("g1", 2, 2, "live * rho"), ("c", 0, 0, "(phi - 1) * pstar"), ("psi", 2, 0, "live"), ("pi", 1, 0, "link"),
)
SIZES = {"states": 3, "shocks": 1, "errors": 1}
RULES = "select p_partkey, p_size / 25.0::double as phi, p_partkey % 9 / 10.0::double as rho, p_partkey % 4 as k, p_retailprice / 1000.0::double as level from part"


def rules(spark, sf_dir):
    """A rule a part; every fourth has no expectation error, every fourth no law for r."""
    k = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") / 25.0).alias("phi"), (F.col("p_partkey") % 9 / 10.0).alias("rho"), (F.col("p_retailprice") / 1000.0).cast("double").alias("level"),
        F.when(k == 2, 0.0).otherwise(1.0).alias("link"), F.when(k == 3, 0.0).otherwise(1.0).alias("live"),
    )


def rule_table(spark):
    return spark.createDataFrame(RULE, "matrix string, row int, column int, expression string")


def rule_model(spark) -> Model:
    return equations.model_of(rule_table(spark), SIZES, ["phi", "rho", "link", "live", "level"], [("pstar", "log(1 + level) / 2")])


@query(
    f"""with x as ({RULES}) select p_partkey, case when k = 3 then -2 when k = 2 and phi > 1 then 0 else 1 end as "exists", case when k = 3 then -2 when k = 2 or phi > 1 then 1 else 0 end as "unique",
 case when k < 2 and phi > 1 then round(1 / (phi - rho), 6) when k = 2 and phi <= 1 then 0.0 end as response from x"""
)
def solver_codes(spark, sf_dir):
    """Existence and uniqueness of every part's rule, and the inflation response where both hold."""
    out = equations.solutions(rules(spark, sf_dir), ["p_partkey"], rule_model(spark), method="expectations")
    return out.select("p_partkey", "exists", "unique", F.when((F.col("exists") == 1) & (F.col("unique") == 1), F.round(F.element_at("r", 1), 6) + F.lit(0.0)).alias("response"))


@query(
    f"""with x as (select *, ln(1 + level) / 2 as pstar from ({RULES}) where k < 2 and phi > 1)
select p_partkey, round(pstar, 6) as level, round(1 / (phi - rho), 6) as impact, round(rho / (phi - rho), 6) as carried, round(rho / (phi - rho), 6) as expected from x"""
)
def equation_model(spark, sf_dir):
    """The determinate rules' solutions: level, impact and what last quarter's real rate and this one's shock leave."""
    determinate = rules(spark, sf_dir).where("link = 1 and live = 1 and phi > 1")
    out = equations.solutions(determinate, ["p_partkey"], rule_model(spark)).where("exists = 1 and unique = 1")
    return out.select("p_partkey", *[F.round(F.element_at(c, k), 6).alias(n) for n, c, k in (("level", "c", 1), ("impact", "r", 1), ("carried", "t", 3), ("expected", "r", 2))])


@query(
    f"""with x as (select *, ln(1 + level) / 2 as pstar, (k <> 2)::int::double as link, (k <> 3)::int::double as live from ({RULES})),
c as (select p_partkey, unnest([{", ".join(f"{{'matrix': '{m}', 'row': {i}, 'column': {j}, 'value': ({e})::double}}" for m, i, j, e in RULE)}]) as c from x)
select p_partkey, c.matrix as matrix, c.row as row, c.column as "column", round(c.value, 6) + 0.0 as value from c"""
)
def equation_cells(spark, sf_dir):
    out = equations.cells(rules(spark, sf_dir), ["p_partkey"], rule_model(spark))
    return out.withColumn("value", F.round("value", 6) + F.lit(0.0))


CUBIC = Model({}, (), ("p", "q"), (Root("x", "x ** 3 + p * x - q", "0", "q / p"), ("y", "x ** 2")))


@query(
    """with x as (select p_partkey, p_size / 10.0::double as p, p_retailprice / 1000.0::double as q from part), d as (select *, sqrt(q * q / 4 + p * p * p / 27) as d from x),
r as (select p_partkey, cbrt(d + q / 2) - cbrt(d - q / 2) as x from d) select p_partkey, round(x, 6) as x, round(x * x, 6) as y from r"""
)
def row_roots(spark, sf_dir):
    """One root a row by bracketed secants, against the closed form of a cubic."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("p"), (F.col("p_retailprice") / 1000.0).cast("double").alias("q"))
    out = equations.named_values(p, ["p_partkey"], CUBIC, ["x", "y"])
    return out.select("p_partkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


#: A contract whose spread makes the premium's elasticity what it is at `known`.
CONTRACT = Model({}, (), ("z", "spr", "known"), (("target", "premium_elasticity(z, known, spr)"), Root("sigma", "premium_elasticity(z, sigma, spr) - target", "0.05", "1.0", 0.5), ("miss", "premium_elasticity(z, sigma, spr) - target")))


@query("select p_partkey, round(0.2 + p_size / 100.0::double, 5) as sigma, 0.0::double as miss from part")
def contract_spreads(spark, sf_dir):
    """The steady state's spread of every part's contract, from the premium elasticity it must have."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("-2.4D + (p_partkey % 5) / 20D").alias("z"), F.expr("1.002D + (p_partkey % 4) / 1000D").alias("spr"), F.expr("0.2D + p_size / 100D").alias("known"))
    out = equations.named_values(p, ["p_partkey"], CONTRACT, ["sigma", "miss"])
    return out.select("p_partkey", F.round("sigma", 5).alias("sigma"), (F.round("miss", 7) + F.lit(0.0)).alias("miss"))


#: An autoregression around a level, observed with noise.
NOISY = Model(
    {"states": 1, "shocks": 1, "observables": 1},
    (("g0", 0, 0, "1"), ("g1", 0, 0, "rho"), ("psi", 0, 0, "1"), ("q", 0, 0, "sigma ** 2"), ("z", 0, 0, "1"), ("d", 0, 0, "mu"), ("eps", 0, 0, "noise ** 2")),
    ("rho", "sigma", "mu", "noise"),
)
PRIOR = (0.5, 0.2)


def draws(spark, sf_dir):
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (s % 40 / 50.0).alias("rho"), (0.05 + s % 7 / 20.0).alias("sigma"), F.lit(1.4).alias("mu"), (0.05 + s % 3 / 10.0).alias("noise"))


def one_series(spark, sf_dir) -> np.ndarray:
    return collected(observed(spark, sf_dir).where("series = '1-URGENT'"), "quarter_idx", ["y"])


def rho_prior():
    return T.log_prior(F.lit("normal"), "rho", *map(F.lit, PRIOR), F.lit(T.prior_normaliser("normal", *PRIOR)))


POSTERIORS = f"""with recursive {BASE}, o as (select t, y from y where series = '1-URGENT'),
d as (select s_suppkey, s_suppkey % 40 / 50.0::double as rho, 0.05 + s_suppkey % 7 / 20.0::double as sigma, 0.05 + s_suppkey % 3 / 10.0::double as noise from supplier),
f(s_suppkey, rho, q, e, t, s, p, ll) as (
  select s_suppkey, rho, sigma * sigma, noise * noise, 0::bigint, 0::double, sigma * sigma / (1 - rho * rho), 0::double from d
  union all
  select s_suppkey, rho, q, e, o.t, case when y is null then rho * s else rho * s + (rho * rho * p + q) / (rho * rho * p + q + e) * (y - 1.4 - rho * s) end,
   case when y is null then rho * rho * p + q else (rho * rho * p + q) * e / (rho * rho * p + q + e) end,
   ll + case when y is null then 0 else -0.5 * (ln(2 * pi()) + ln(rho * rho * p + q + e) + (y - 1.4 - rho * s) ** 2 / (rho * rho * p + q + e)) end
  from f join o on o.t = f.t + 1),
lp as (select s_suppkey, ll - 0.5 * ((rho - {PRIOR[0]}) / {PRIOR[1]}) ** 2 - ln({PRIOR[1]}) - 0.5 * ln(2 * pi()) as v from f where t = (select max(t) from o))"""


@query(POSTERIORS + f" select s_suppkey, round(v + 0.5 * ((rho - {PRIOR[0]}) / {PRIOR[1]}) ** 2 + ln({PRIOR[1]}) + 0.5 * ln(2 * pi()), 4) as loglik, round(v, 4) as log_posterior from lp join d using (s_suppkey)")
def log_posterior_kalman(spark, sf_dir):
    """The posterior of every draw's system by one filter over a batch of draws."""
    d = draws(spark, sf_dir)
    like = equations.log_likelihoods(d, ["s_suppkey", "rho"], NOISY, one_series(spark, sf_dir))
    return like.select("s_suppkey", F.round("loglik", 4).alias("loglik"), F.round(F.col("loglik") + rho_prior(), 4).alias("log_posterior"))


@query(
    POSTERIORS
    + """, r as (select 'proposal' as field, v, s_acctbal / 100 as recorded from lp join supplier using (s_suppkey) union all select 'previous', lp.v, n.s_acctbal / 100 from lp join supplier n on n.s_suppkey = lp.s_suppkey + 1)
select field, count(*) as n, round(avg(v - recorded), 3) as offset_mean, round(stddev_pop(v - recorded), 3) as offset_sd, round(max(abs(v - recorded)), 3) as max_abs, false as passed from r group by field"""
)
def posterior_replay(spark, sf_dir):
    """Posteriors of saved proposals and of what they were proposed from, computed anew and held against what was recorded."""
    d = draws(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).cast("double").alias("recorded"))
    before = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), "recorded")
    trace = d.join(s, "s_suppkey").withColumn("field", F.lit("proposal")).unionByName(d.join(before, "s_suppkey").withColumn("field", F.lit("previous")))
    out = estimation.replay_report(estimation.replayed(trace, ["field", "s_suppkey"], NOISY, one_series(spark, sf_dir), rho_prior()), ["field"], 1e-6, 1e-8)
    return out.select("field", "n", *[F.round(c, 3).alias(c) for c in ("offset_mean", "offset_sd", "max_abs")], "passed")


@query(f"with {BASE} select n_nationkey, round((select avg(y) from y where series = '1-URGENT'), 4) as mu, true as settled from nation")
def refreshed_level(spark, sf_dir):
    """Every nation's model with its level moved to the posterior's maximum: without persistence, the series' mean."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(0.0).alias("rho"), (0.1 + F.col("n_nationkey") / 50.0).alias("sigma"), (F.col("n_nationkey") / 10.0).alias("mu"), F.lit(0.1).alias("noise"))
    out = estimation.refreshed(n, ["n_nationkey"], NOISY, ["mu"], one_series(spark, sf_dir))
    return out.select("n_nationkey", F.round("mu", 4).alias("mu"), "settled")


def _cubic(x, row):
    return -0.5 * (row["k"] * x[:, 0] ** 2 + 3 * x[:, 1] ** 2 + x[:, 0] * x[:, 1]) + x[:, 0] ** 3 / 6


@query(
    """with x as (select p_partkey, p_size / 50.0::double as x, 1 + p_partkey % 5 as k from part)
select p_partkey, 0 as i, 0 as j, round(x - k, 4) as value from x union all select p_partkey, i, 1 - i, -0.5 from x, (values (0), (1)) as t(i) union all select p_partkey, 1, 1, -3.0 from x"""
)
def hessian_stencil(spark, sf_dir):
    """The Hessian of every part's own density at its own point."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size") / 50.0, (F.col("p_retailprice") / 2000.0).cast("double")).alias("x"), (1 + F.col("p_partkey") % 5).alias("k"))
    return estimation.hessians(p, ["p_partkey"], _cubic, 2, ["k"], 1e-3).withColumn("value", F.round("value", 4) + F.lit(0.0))


def _bowl(x, row):
    a, b = x[:, 0] - row["a"], x[:, 1] - row["b"]
    return -(a * a + 2 * b * b + a * b) - 0.05 * (a * a + b * b) ** 2


OPTIMUM = "select p_partkey, round(p_size / 10.0::double, 3) as a, round(p_partkey % 11 / 4.0::double, 3) as b, 0.0::double as value, true as settled from part"


def _optimum(spark, sf_dir, method):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("a"), (F.col("p_partkey") % 11 / 4.0).alias("b"), F.array(F.lit(0.5), (F.col("p_retailprice") / 500.0).cast("double")).alias("x"))
    out = estimation.optima(p, ["p_partkey"], _bowl, ["a", "b"], method)
    return out.select("p_partkey", *[(F.round(F.col("x")[k], 3) + F.lit(0.0)).alias(n) for k, n in enumerate("ab")], (F.round("value", 6) + F.lit(0.0)).alias("value"), "settled")


@query(OPTIMUM)
def simplex_optima(spark, sf_dir):
    """Where a simplex from every part's start ends."""
    return _optimum(spark, sf_dir, "simplex")


@query(OPTIMUM)
def direction_optima(spark, sf_dir):
    """Where line searches along changing directions from every part's start end."""
    return _optimum(spark, sf_dir, "directions")


def _around(x, row):
    return -0.5 * ((x[:, 0] - row["mean"]) ** 2 + (x[:, 1] + row["mean"]) ** 2 / 0.25)


@query()
def mh_chain(spark, sf_dir):
    """A chain a nation on the nation's own density, adaptive, in two blocks; tests hold moments and resumed chains against it."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") / 10.0).alias("mean"), F.array(F.col("n_nationkey") / 10.0, F.lit(0.0)).alias("x"))
    sampler = estimation.Sampler(np.diag([1.0, 0.3]), draws=250, seed=7, rounds=4, burn_rounds=1, blocks=2, target=0.4, alpha=0.9, c=0.5)
    return estimation.draws_of(estimation.chains(n, "n_nationkey", _around, sampler, ["mean"], every=500), "n_nationkey")


@query()
def posterior_chains(spark, sf_dir):
    """Chains on the Kalman posterior of rho and log sigma of one series, from every nation's start; tests hold them against a grid."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.array(0.2 + F.col("n_nationkey") / 50.0, F.lit(-1.5)).alias("x"), F.lit(1.4).alias("mu"), F.lit(0.1).alias("noise"))
    sampler = estimation.Sampler(np.diag([0.05, 0.1]), draws=60, seed=11, burn=20)
    return estimation.draws_of(estimation.chains(n, "n_nationkey", series_posterior(one_series(spark, sf_dir)), sampler, ["mu", "noise"]), "n_nationkey")


def series_posterior(data: np.ndarray) -> estimation.Objective:
    """Log posterior of (rho, log sigma), with a normal prior on rho; outside (-1, 1) there is none."""
    model = Model(NOISY.sizes, NOISY.cells, ("rho", "line", "mu", "noise"), (("sigma", "exp(line)"),))

    def prior(x, row):
        return np.where(np.abs(x[:, 0]) < 1, -0.5 * ((x[:, 0] - PRIOR[0]) / PRIOR[1]) ** 2 - np.log(PRIOR[1]) - 0.5 * np.log(2 * np.pi), -np.inf)

    return estimation.posterior(model, ["rho", "line"], data, prior)
