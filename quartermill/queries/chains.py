"""Sampler diagnostics and parameter transforms, with tables standing in for traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transforms as T
from ..operators import diagnostics
from .registry import query, table

TRACE = "select c_mktsegment as chain, c_custkey as draw, c_acctbal > 2000 as accepted, c_acctbal / 1000 as value from customer"


def trace(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("chain"), F.col("c_custkey").alias("draw"), F.expr("c_acctbal > 2000").alias("accepted"), (F.col("c_acctbal") / 1000).alias("value"))


@query(f"with t as ({TRACE}), w as (select *, ntile(7) over (partition by chain order by draw) as win from t) select chain, win::int as window, round(avg(accepted::int), 6) as rate, count(*) as n from w group by chain, win")
def acceptance_windows(spark, sf_dir):
    return diagnostics.acceptance_windows(trace(spark, sf_dir), ["chain"], "draw", 7).withColumn("rate", F.round("rate", 6))


@query(f"with t as ({TRACE}) select chain, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as sd, min(value) as low, max(value) as high, count(value) as n from t group by chain")
def chain_moments(spark, sf_dir):
    return diagnostics.moments(trace(spark, sf_dir), ["chain"], "value").withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query(
    f"""with t as ({TRACE}), r as (select chain, value, row_number() over (partition by chain order by draw) as i, count(*) over (partition by chain) as n from t),
h as (select chain, case when i <= n // 2 then 1 else 2 end as part, avg(value) as m, var_samp(value) as s, count(*) as c from r where n >= 4 and (i <= n // 2 or i > n - n // 2) group by all),
b as (select chain, avg(s) as w, var_samp(m) * max(c) as bt, max(c) as c from h group by chain)
select chain, round(sqrt(((c - 1) / c * w + bt / c) / w), 6) as rhat from b"""
)
def split_rhat(spark, sf_dir):
    return diagnostics.split_rhat(trace(spark, sf_dir), ["chain"], "draw", "value").withColumn("rhat", F.round("rhat", 6))


@query(
    f"""with t as ({TRACE}), r as (select chain, value - avg(value) over (partition by chain) as x, row_number() over (partition by chain order by draw) as i, count(*) over (partition by chain) as n from t),
v as (select chain, avg(x * x) as var, max(n) as n from r group by chain),
l as (select a.chain, b.i - a.i as lag, sum(a.x * b.x) / max(a.n - b.i + a.i) as cov from r a join r b on a.chain = b.chain and b.i > a.i group by all),
rho as (select chain, lag, cov / var as rho from l join v using (chain)),
s as (select *, max(case when rho <= 0 then 1 else 0 end) over (partition by chain order by lag) as stop from rho),
k as (select chain, greatest(1, 1 + 2 * sum(case when stop = 0 then rho else 0 end)) as iat from s group by chain)
select chain, v.n, round(least(v.n, v.n / iat), 4) as ess from v join k using (chain)"""
)
def ess_autocorr(spark, sf_dir):
    return diagnostics.effective_size(trace(spark, sf_dir), ["chain"], "draw", "value").select("chain", "n", F.round("ess", 4).alias("ess"))


@query(
    """with t as (select o_orderkey, o_totalprice / 50000 as previous_logpost, o_totalprice / 49000 - 1 as proposed_logpost, (o_orderkey % 997 + 1) / 998.0::double as u, o_orderstatus = 'F' as accepted from orders)
select o_orderkey, round(proposed_logpost - previous_logpost, 6) as log_alpha, ln(u) < least(0, proposed_logpost - previous_logpost) as expected,
 round(case when ln(u) < least(0, proposed_logpost - previous_logpost) then proposed_logpost else previous_logpost end, 6) as retained, (ln(u) < least(0, proposed_logpost - previous_logpost)) = accepted as agrees from t"""
)
def proposal_trace_replay(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") / 50000).alias("previous_logpost"),
        (F.col("o_totalprice") / 49000 - 1).alias("proposed_logpost"),
        F.expr("(o_orderkey % 997 + 1) / 998.0D").alias("u"),
        F.expr("o_orderstatus = 'F'").alias("accepted"),
    )
    out = diagnostics.replayed(t)
    return out.select("o_orderkey", F.round("log_alpha", 6).alias("log_alpha"), "expected", F.round("retained", 6).alias("retained"), "agrees")


KINDS = ["exponential", "bounded", "square", "identity"]


@query(
    """with p as (select p_partkey, p_size / 10.0::double as x, ['exponential', 'bounded', 'square', 'identity'][p_partkey % 4 + 1] as kind from part),
m as (select *, case kind when 'exponential' then exp(x) when 'bounded' then 1e-5 + (0.999 - 1e-5) / (1 + exp(-x)) when 'square' then x * x else x end as v from p)
select p_partkey, kind, round(v, 6) as model_value, round(case kind when 'exponential' then ln(v) when 'bounded' then ln((v - 1e-5) / (0.999 - v)) when 'square' then sqrt(v) else v end, 6) as line_value from m"""
)
def parameter_transforms(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.expr("cast(p_partkey % 4 + 1 as int)"))
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("x"), kind.alias("kind"))
    m = p.withColumn("v", T.to_model("kind", "x", F.lit(1e-5), F.lit(0.999)))
    return m.select("p_partkey", "kind", F.round("v", 6).alias("model_value"), F.round(T.to_line("kind", "v", F.lit(1e-5), F.lit(0.999)), 6).alias("line_value"))


@query(
    """select p_partkey, round(1 / (1 + p_size / 100), 6) as discount, round(1 + p_size / 100, 6) as gross, round(1 - (1 - p_size / 100) ** 0.25, 6) as fomega,
 round((1 + p_size / 100) ** 0.25, 6) as quarterly_spread, round(p_size / 100, 6) as percent from part"""
)
def parameter_scalings(spark, sf_dir):
    p, x = table(spark, sf_dir, "part"), F.col("p_size").cast("double")
    at = {"fomega": x / 100}
    return p.select("p_partkey", *[F.round(T.SCALINGS[n](at.get(n, x)), 6).alias(n) for n in ("discount", "gross", "fomega", "quarterly_spread", "percent")])


#: name, a, b of the priors that log_priors evaluates.
PRIORS = [("normal", 0.5, 0.2), ("uniform", 0.0, 1.0), ("gamma", 2.0, 0.3), ("beta", 2.0, 3.0), ("root_inverse_gamma", 2.0, 0.1)]
_VALUES = ", ".join(f"('{n}', {a}::double, {b}::double)" for n, a, b in PRIORS)


@query(
    f"""with r(prior, a, b) as (values {_VALUES}),
k as (select *, case prior when 'normal' then -ln(b) - 0.5 * ln(2 * pi()) when 'uniform' then -ln(b - a) when 'gamma' then -lgamma(a) - a * ln(b) when 'beta' then lgamma(a + b) - lgamma(a) - lgamma(b)
 else ln(2) - lgamma(a / 2) + a / 2 * ln(a * b * b / 2) end as c from r), x as (select p_partkey, p_size / 51.0::double as x from part)
select p_partkey, prior, round(c + case prior when 'normal' then -0.5 * ((x - a) / b) ** 2 when 'uniform' then 0 when 'gamma' then (a - 1) * ln(x) - x / b
 when 'beta' then (a - 1) * ln(x) + (b - 1) * ln(1 - x) else -(a + 1) * ln(x) - a * b * b / (2 * x * x) end, 6) as log_density from x, k"""
)
def log_priors(spark, sf_dir):
    rows = [(n, a, b, T.prior_normaliser(n, a, b)) for n, a, b in PRIORS]
    priors = F.explode(F.array(*[F.struct(F.lit(n).alias("prior"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for n, a, b, c in rows]))
    x = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 51.0).alias("x"), priors.alias("p")).select("p_partkey", "x", "p.*")
    return x.select("p_partkey", "prior", F.round(T.log_prior("prior", "x", "a", "b", "c"), 6).alias("log_density"))
