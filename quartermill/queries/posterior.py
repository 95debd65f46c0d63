"""Priors, likelihoods, draws and their diagnostics as relational plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import transforms as T
from ..functions.quarters import quarter_index
from ..operators import diagnostics, ingest
from ..plans import frictions, posterior
from .registry import query, table
from .series import BY_PRIORITY

MOMENTS = [("gamma", 0.6, 0.3), ("beta", 0.5, 0.2)]


@query(
    """with x as (select p_partkey, p_size / 51.0::double as x from part), g as (select (0.6 / 0.3) ** 2 as a, 0.3 ** 2 / 0.6 as b), w as (select 0.5 * 0.5 / 0.2 ** 2 - 1 as w)
select p_partkey, 'gamma' as prior, round((a - 1) * ln(x) - x / b - lgamma(a) - a * ln(b), 6) as log_density from x, g
union all select p_partkey, 'beta', round((0.5 * w - 1) * ln(x) + (0.5 * w - 1) * ln(1 - x) + lgamma(w) - 2 * lgamma(0.5 * w), 6) from x, w"""
)
def priors_by_moments(spark, sf_dir):
    rows = [(n, a, b, T.prior_normaliser(n, a, b)) for n, a, b in (T.by_moments(*m) for m in MOMENTS)]
    priors = F.explode(F.array(*[F.struct(F.lit(n).alias("prior"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for n, a, b, c in rows]))
    x = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 51.0).alias("x"), priors.alias("p")).select("p_partkey", "x", "p.*")
    return x.select("p_partkey", "prior", F.round(T.log_prior("prior", "x", "a", "b", "c"), 6).alias("log_density"))


PARAMETERS = """select s_nationkey as draw, s_name as name, s_suppkey % 4 = 0 as fixed, case s_suppkey % 3 when 0 then null when 1 then 'normal' else 'uniform' end as prior, s_acctbal / 10000 as value from supplier"""


def parameters(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("draw"), F.col("s_name").alias("name"), F.expr("s_suppkey % 4 = 0").alias("fixed"), F.expr("case s_suppkey % 3 when 1 then 'normal' when 2 then 'uniform' end").alias("prior"),
        (F.col("s_acctbal") / 10000).alias("value"), F.expr("case when s_suppkey % 3 = 1 then 0.2D else -1D end").alias("a"), F.expr("case when s_suppkey % 3 = 1 then 0.5D else 1D end").alias("b"),
        F.expr(f"case when s_suppkey % 3 = 1 then {T.prior_normaliser('normal', 0.2, 0.5)!r}D else {T.prior_normaliser('uniform', -1.0, 1.0)!r}D end").alias("log_norm"),
    )


@query(
    f"""with p as ({PARAMETERS}) select draw, round(sum(case when fixed or prior is null then 0 when prior = 'normal' then -0.5 * ((value - 0.2) / 0.5) ** 2 - ln(0.5) - 0.5 * ln(2 * pi())
 when value between -1 and 1 then -ln(2.0::double) end), 6) + 0.0::double as log_prior from p group by draw"""
)
def prior_sum(spark, sf_dir):
    return posterior.prior_sum(parameters(spark, sf_dir), ["draw"]).withColumn("log_prior", F.round("log_prior", 6) + F.lit(0.0))


@query(f"with p as ({PARAMETERS}) select draw, name from p where not fixed and prior is not null")
def estimated_parameters(spark, sf_dir):
    return posterior.estimated(parameters(spark, sf_dir)).select("draw", "name")


@query(
    f"""with q as ({BY_PRIORITY}), y as (select o_orderpriority, quarter_idx, value / 1e5 - 1.4 as y from q), l as (select *, lag(y) over (partition by o_orderpriority order by quarter_idx) as z from y),
p as (select n_nationkey as point, n_nationkey / 25.0::double as rho, 0.05 + n_nationkey / 100.0::double as sigma from nation),
k as (select o_orderpriority, point, rho, sigma, sum(-0.5 * ln(2 * pi() * sigma * sigma) - (y - rho * z) ** 2 / (2 * sigma * sigma)) as ll from l, p where z is not null group by all)
select o_orderpriority, point, round(ll, 4) as loglik, round(ll - 0.5 * ((rho - 0.5) / 0.2) ** 2 - ln(0.2) - 0.5 * ln(2 * pi()), 4) as log_posterior from k"""
)
def log_posterior_grid(spark, sf_dir):
    """Log posterior of an autoregression at 25 points, for every series at once."""
    q = ingest.quarterly(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice", places=2).withColumn("y", F.col("value") / 1e5 - 1.4)
    points = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("point"), (F.col("n_nationkey") / 25.0).alias("rho"), (0.05 + F.col("n_nationkey") / 100.0).alias("sigma"))
    out = posterior.ar1_loglik(q, ["o_orderpriority"], "quarter_idx", "y", points)
    prior = T.log_prior(F.lit("normal"), "rho", F.lit(0.5), F.lit(0.2), F.lit(T.prior_normaliser("normal", 0.5, 0.2)))
    return out.select("o_orderpriority", "point", F.round("loglik", 4).alias("loglik"), F.round(F.col("loglik") + prior, 4).alias("log_posterior"))


@query(
    """with v as (select p_partkey, p_size / 10.0::double - 1 as x, p_retailprice / 1000.0 - 0.5 as y, 1.0::double as a, 0.3::double as b, 2.0::double as d from part), i as (select *, a * d - b * b as det from v)
select p_partkey, round(-0.5 * ((d * x * x - 2 * b * x * y + a * y * y) / det) - 0.5 * ln(det) - ln(2 * pi()), 6) as log_density from i"""
)
def mvn_logpdf(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size") / 10.0 - 1, F.col("p_retailprice") / 1000.0 - 0.5).alias("x"), F.array(F.lit(0.0), F.lit(0.0)).alias("m"), F.array(*map(F.lit, (1.0, 0.3, 0.3, 2.0))).alias("c"))
    return p.select("p_partkey", F.round(posterior.mvn_logpdf("x", "m", "c"), 6).alias("log_density"))


@query(
    """with b as (select *, md5('7|' || n_regionkey::varchar || '|' || n_name) as o from nation), r as (select *, row_number() over (partition by n_regionkey order by o, n_name) - 1 as i, count(*) over (partition by n_regionkey) as n from b)
select n_regionkey, n_name as name, floor(i / ceil(n / 2.0))::int as block from r"""
)
def random_blocks(spark, sf_dir):
    return posterior.random_blocks(table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("name")), ["n_regionkey"], 2, "7")


CELLS = "select c_mktsegment as key, unnest([0, 0, 1, 1]) as i, unnest([0, 1, 0, 1]) as j, unnest([a, b, b, d]) as value from (select c_mktsegment, var_samp(c_acctbal / 1000) as a, covar_samp(c_acctbal / 1000, c_nationkey) as b, var_samp(c_nationkey) as d from customer group by 1)"


def cells(spark, sf_dir):
    x = F.col("c_acctbal") / 1000
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.var_samp(x).alias("a"), F.covar_samp(x, F.col("c_nationkey").cast("double")).alias("b"), F.var_samp("c_nationkey").alias("d"))
    four = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(c).alias("value")) for i, j, c in ((0, 0, "a"), (0, 1, "b"), (1, 0, "b"), (1, 1, "d"))])
    return s.select("key", F.explode(four).alias("c")).select("key", "c.*")


@query(
    f"""with c as ({CELLS}), m as (select key, max(value) filter (where i = 0 and j = 0) as a, max(value) filter (where i = 0 and j = 1) as b, max(value) filter (where i = 1 and j = 1) as d from c group by 1),
e as (select key, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) as lo, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) as hi from m)
select key, 2::bigint as n, round(lo, 6) as low, round(hi, 6) as high, round(hi / lo, 4) as condition, lo >= -1e-12 as semidefinite from e"""
)
def covariance_health(spark, sf_dir):
    out = diagnostics.covariance_health(cells(spark, sf_dir), "key")
    return out.select("key", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("condition", 4).alias("condition"), "semidefinite")


@query(f"with c as ({CELLS}) select key, i, j, round(value * 0.25, 6) as value from c")
def proposal_scale(spark, sf_dir):
    return posterior.proposal_scale(cells(spark, sf_dir), 0.5).withColumn("value", F.round("value", 6))


@query("select c_mktsegment as chain, count(*) as n, round(avg((c_acctbal > 2000)::int), 6) as acceptance, round(avg(c_acctbal), 4) as logpost_mean, min(c_acctbal) as logpost_min, max(c_acctbal) as logpost_max from customer group by 1")
def chain_summary(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("chain"), F.expr("c_acctbal > 2000").alias("accepted"), F.col("c_acctbal").alias("logpost"))
    out = diagnostics.chain_summary(t, ["chain"], "logpost")
    return out.withColumns({"acceptance": F.round("acceptance", 6), "logpost_mean": F.round("logpost_mean", 4)})


@query(
    """with t as (select c_mktsegment as chain, c_custkey as draw, c_acctbal / 1000 as value from customer),
r as (select chain, value, value - avg(value) over (partition by chain) as x, row_number() over (partition by chain order by draw) as i, count(*) over (partition by chain) as n from t),
v as (select chain, avg(x * x) as var, max(n) as n, stddev_samp(value) as sd, avg(value) as mean from r group by chain),
l as (select a.chain, b.i - a.i as lag, sum(a.x * b.x) / max(a.n - b.i + a.i) as cov from r a join r b on a.chain = b.chain and b.i > a.i group by all),
s as (select chain, lag, cov / var as rho, max(case when cov <= 0 then 1 else 0 end) over (partition by chain order by lag) as stop from l join v using (chain)),
k as (select chain, greatest(1, 1 + 2 * sum(case when stop = 0 then rho else 0 end)) as iat from s group by chain)
select chain, v.n::bigint as n, round(mean, 6) as mean, round(sd, 6) as sd, round(sd / sqrt(least(v.n, v.n / iat)), 6) as mcse from v join k using (chain)"""
)
def parameter_diagnostics(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("chain"), F.col("c_custkey").alias("draw"), (F.col("c_acctbal") / 1000).alias("value"))
    out = diagnostics.parameter_diagnostics(t, ["chain"], "draw", "value")
    return out.select("chain", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "mcse")])


@query(
    """with d as (select p_partkey as draw, p_size / 60.0::double as rho, p_retailprice / 1234.567::double as s0 from part)
select draw, h::int as h, 0 as variable, round(s0 * rho ** (h + 1) + 0.1 * (1 - rho ** (h + 1)) / (1 - rho), 6) as value from d, generate_series(0, 7) as g(h)"""
)
def parameter_draw_forecasts(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("draw"), (F.col("p_size") / 60.0).alias("rho"), (F.col("p_retailprice") / 1234.567).alias("s0"))
    ones = lambda p, *shape: np.ones((len(p["rho"]), *shape))
    build = lambda p: (p["rho"][:, None, None], 0.1 * ones(p, 1), ones(p, 1, 1), 0 * ones(p, 1), p["s0"][:, None])
    return posterior.parameter_forecasts(d, "draw", ["rho", "s0"], build, 8).withColumn("value", F.round("value", 6))


@query(
    """with s as (select p_partkey, p_size / 60.0::double as t from part), g as (select p_partkey, t, k::int as k from s, generate_series(1, 5) as x(k))
select p_partkey, k, round(t ** k, 6) as power, round(0.2 * (1 - t ** k) / (1 - t), 6) as constant, round(t * (1 - t ** k) / (1 - t), 6) as power_sum from g"""
)
def expected_states(spark, sf_dir):
    s = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size") / 60.0).alias("t"), F.array(F.lit(0.2)).alias("c"))
    out = posterior.expectations(s, "p_partkey", 5)
    return out.select("p_partkey", "k", *[F.round(c, 6).alias(c) for c in ("power", "constant", "power_sum")])


@query(
    """with g as (select distinct (year(o_orderdate) * 4 + quarter(o_orderdate))::int as quarter_idx from orders), c as (select a.n_name as shock_i, b.n_name as shock_j, case when a.n_name = b.n_name then 1.0 + a.n_nationkey else 0.1 end::double as value from nation a, nation b where a.n_regionkey = 1 and b.n_regionkey = 1)
select quarter_idx, shock_i, shock_j, case when quarter_idx < 7990 and (shock_i in ('NATION_1', 'NATION_6') or shock_j in ('NATION_1', 'NATION_6')) then 0 else value end as value from g, c"""
)
def regime_noise(spark, sf_dir):
    g = table(spark, sf_dir, "orders").select(quarter_index("o_orderdate").alias("quarter_idx")).distinct()
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    c = n.select(F.col("n_name").alias("shock_i"), F.col("n_nationkey").alias("k")).crossJoin(n.select(F.col("n_name").alias("shock_j")))
    c = c.select("shock_i", "shock_j", F.expr("case when shock_i = shock_j then 1.0D + k else 0.1D end").alias("value"))
    return posterior.regime_noise(g, c, ["NATION_1", "NATION_6"], 7990)


@query(f"with q as (select distinct quarter_idx from ({BY_PRIORITY})), b as (select *, row_number() over (order by quarter_idx desc) as back from q) select quarter_idx, case when quarter_idx >= 8000 then 'conditional' else 'history' end as dated, case when back <= 3 then 'conditional' else 'history' end as counted from b")
def history_split(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select(quarter_index("o_orderdate").alias("quarter_idx")).distinct()
    dated = posterior.split_history(q, 8000).withColumnRenamed("part", "dated")
    return dated.join(posterior.split_history(q, None, 3).withColumnRenamed("part", "counted"), "quarter_idx")


@query()
def friction_contracts(spark, sf_dir):
    """Sixteen quantities of a contract per part; tests hold slopes against differences."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("-2.5D + p_size / 50D").alias("z"), F.expr("0.2D + (p_partkey % 7) / 20D").alias("sigma"), F.expr("1.002D + (p_partkey % 5) / 1000D").alias("spr"))
    return frictions.contracts(p, "p_partkey")
