"""Forecast driver, scenario runner and time-varying noise over rows of given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.quarters import quarter_index
from ..operators.bands import bands
from ..plans import forecasting, statespace
from .kernels import BASE, LEVEL, observed
from .models import NOISY, draws, one_series
from .registry import query, table

DRAWS = "d as (select s_suppkey, s_suppkey % 40 / 50.0::double as rho, 0.05 + s_suppkey % 7 / 20.0::double as sigma, 0.05 + s_suppkey % 3 / 10.0::double as noise, 1.4::double as mu from supplier)"


def _filter(select: str, last: str = "") -> str:
    """The filter of every draw's system over one series, up to its last quarters as `last` says, and a selection from its end e (s: state)."""
    return f"""with recursive {BASE}, o as (select t, y from y where series = '1-URGENT'), {DRAWS},
f(s_suppkey, rho, mu, q, e, t, s, p) as (
  select s_suppkey, rho, mu, sigma * sigma, noise * noise, 0::bigint, 0::double, sigma * sigma / (1 - rho * rho) from d
  union all
  select s_suppkey, rho, mu, q, e, o.t, case when y is null then rho * s else rho * s + (rho * rho * p + q) / (rho * rho * p + q + e) * (y - mu - rho * s) end,
   case when y is null then rho * rho * p + q else (rho * rho * p + q) * e / (rho * rho * p + q + e) end
  from f join o on o.t = f.t + 1),
e as (select * from f where t = (select max(t) from o) {last}) {select}"""


@query(_filter("select s_suppkey, h::int as h, round(mu + s * case when h = -1 then 1 else rho ** (h + 1) end, 5) as value from e, generate_series(0, 7) as g(h)"))
def draw_forecasts(spark, sf_dir):
    """Every draw's forecast from the state its own filter ends in."""
    out = forecasting.forecasts(draws(spark, sf_dir), ["s_suppkey"], NOISY, one_series(spark, sf_dir), 8)
    return out.select("s_suppkey", "h", F.round("value", 5).alias("value"))


@query(
    _filter(
        """, l as (select y from o where t = (select max(t) from o)),
a as (select 'semi' as cond, s_suppkey, h::int as h, 'forecast' as part, round(mu + s * rho ** h, 5) as value from e, generate_series(1, 5) as g(h)),
b as (select 'full' as cond, s_suppkey, h::int as h, case when h = 0 then 'conditional' else 'forecast' end as part, round(mu + (y - mu) * case when h = 0 then 1 else rho ** h end, 5) as value from d, l, generate_series(0, 5) as g(h))
select * from a union all select * from b"""
    )
)
def conditional_forecasts(spark, sf_dir):
    """Forecasts with the last quarter as one more observation, or as a path that shocks must meet."""
    data, rows = one_series(spark, sf_dir), draws(spark, sf_dir)
    out = [forecasting.forecasts(rows, ["s_suppkey"], NOISY, data, 6, cond, 1).withColumn("cond", F.lit(cond)) for cond in ("semi", "full")]
    return out[0].unionByName(out[1]).select("cond", "s_suppkey", "h", "part", F.round("value", 5).alias("value"))


def cube(spark, sf_dir):
    """A path of shocks an order, each line item one of its quarters, for one parameter row."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount").repartition("l_orderkey")  # once for an order's quarters and for its path
    return items.groupBy(F.col("l_orderkey").alias("draw"), (F.col("l_linenumber") - 1).alias("h")).agg(F.sum((F.col("l_discount") - 0.05).cast("double") * 10).alias("value")).select(F.lit(1).cast("long").alias("s_suppkey"), "draw", "h", F.lit(0).alias("shock"), "value")


@query(
    _filter(
        """, c as (select l_orderkey as draw, l_linenumber - 1 as h, sum((l_discount - 0.05) * 10)::double as value from lineitem group by all),
g as (select distinct draw, x::int as h from c, generate_series(0, 6) as t(x)),
x as (select g.draw, g.h, any_value(e.mu + e.s * e.rho ** (g.h + 1)) + coalesce(sum(c.value * e.rho ** (g.h - c.h)), 0) as value from g join e on e.s_suppkey = 1 left join c on c.draw = g.draw and c.h <= g.h group by all)
select h, round(avg(value), 5) as mean, round(quantile_cont(value, 0.05), 5) as lower, round(quantile_cont(value, 0.95), 5) as upper from x group by h"""
    )
)
def sampled_forecast_bands(spark, sf_dir):
    """Paths of one system under every order's shocks, then exact quantile bands in Spark."""
    rows = draws(spark, sf_dir).where("s_suppkey = 1").withColumn("s_suppkey", F.col("s_suppkey").cast("long"))
    out = forecasting.forecasts(rows, ["s_suppkey"], NOISY, one_series(spark, sf_dir), 7, shocks=cube(spark, sf_dir))
    return bands(out, ["h"], "value").select("h", *[F.round(c, 5).alias(c) for c in ("mean", "lower", "upper")])


@query(
    """with k as (select n_nationkey, n_nationkey % 3 as k, n_nationkey / 10.0::double as v from nation), g as (select *, h::int as h from k, generate_series(0, 5) as x(h)),
w as (select *, case when h < 3 then v * (h + 1) else v * 3 * 0.8 ** (h - 2) end as want from g),
e as (select *, case k when 1 then case when h = 1 then v when h = 4 then -0.5 * v else 0 end else 2 * (want - 0.8 * coalesce(lag(want) over (partition by n_nationkey order by h), 0)) end as z from w),
d as (select *, case k when 1 then 0.5 * v * (case when h >= 1 then 0.8 ** (h - 1) else 0 end - 0.5 * case when h >= 4 then 0.8 ** (h - 4) else 0 end) else want end as dev from e)
select n_nationkey, 'path' as part, h, 'y' as name, round(0.8 ** (h + 1) + dev, 6) + 0.0 as value from d
union all select n_nationkey, 'shock', h, 'e', round(z, 6) + 0.0 from d
union all select n_nationkey, 'summary', -1, 'largest shock', round(max(abs(z)), 6) from d group by n_nationkey
union all select n_nationkey, 'summary', -1, 'joint norm', round(max(abs(z)), 6) from d group by n_nationkey
union all select n_nationkey, 'summary', -1, 'deviations passed', case when max(abs(z)) > 8 then 8.0 when max(abs(z)) > 4 then 4.0 else 0.0 end from d group by n_nationkey
union all select n_nationkey, 'summary', -1, 'miss', 0.0 from k"""
)
def scenario_runs(spark, sf_dir):
    """Policy paths, structural shocks and conditions of every nation in one plan, with their summaries."""
    n = table(spark, sf_dir, "nation")
    kind = F.element_at(F.array(*map(F.lit, ("policy", "structural", "condition"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    v = F.col("n_nationkey") / 10.0
    path = F.array(*[F.struct(F.lit(h).alias("h"), F.lit("y").alias("name"), ((h + 1) * v).alias("value")) for h in range(3)])
    own = F.array(*[F.struct(F.lit(h).alias("h"), F.lit("e").alias("name"), (w * v).alias("value")) for h, w in ((1, 1.0), (4, -0.5))])
    conditions = n.select("n_nationkey", kind.alias("kind"), F.explode(F.when(F.col("n_nationkey") % 3 == 1, own).otherwise(path)).alias("c")).select("n_nationkey", "kind", "c.*")
    system = statespace.System.of(0.8, 1.0, 0.25, 1.0)
    out = forecasting.run_scenarios(conditions, "n_nationkey", system, np.array([1.0]), 6, ["e"], ["y"], "e")
    return out.select("n_nationkey", "part", "h", "name", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query(
    f"""with recursive {BASE}, v as (select *, case when quarter_idx < 7980 then 0.01 when quarter_idx < 7988 then 0.09 else 0.01 end as q from y),
f(series, t, s, p, ll) as (
  select series, 0::bigint, 0::double, 1e6::double, 0::double from (select distinct series from y)
  union all
  select f.series, v.t, case when y is null then s else s + (p + q) / (p + q + 0.04) * (y - s) end, case when y is null then p + q else (p + q) * 0.04 / (p + q + 0.04) end,
   case when y is null then 0 else -0.5 * (ln(2 * pi()) + ln(p + q + 0.04) + (y - s) * (y - s) / (p + q + 0.04)) end
  from f join v on v.series = f.series and v.t = f.t + 1)
select series, (t - 1)::int as t, round(ll, 5) as loglik, round(s, 5) as state, round(p, 4) as variance from f where t > 0"""
)
def regime_filter(spark, sf_dir):
    """A level filtered under a covariance of its own between two dates."""
    q = table(spark, sf_dir, "orders").select(quarter_index("o_orderdate").alias("quarter_idx")).distinct().where("quarter_idx >= 7980 and quarter_idx < 7988")
    noise = q.select("quarter_idx", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.09).alias("value"))
    out = statespace.filter_groups(observed(spark, sf_dir), "series", "quarter_idx", ["y"], LEVEL, noise=noise)
    return out.select("series", "t", F.round("loglik", 5).alias("loglik"), F.round(F.col("state")[0], 5).alias("state"), F.round(F.col("cov")[0], 4).alias("variance"))


@query(
    """with recursive q as (select l_suppkey, (year(l_shipdate) * 4 + quarter(l_shipdate))::int as quarter_idx, avg(l_quantity)::double / 25 as y from lineitem group by all),
v as (select *, row_number() over (partition by l_suppkey order by quarter_idx) as t from q),
f(l_suppkey, t, s, p, ll) as (
  select l_suppkey, 0::bigint, 0::double, 1e6::double, 0::double from (select distinct l_suppkey from v)
  union all
  select f.l_suppkey, v.t, s + (p + 0.01) / (p + 0.05) * (y - s), (p + 0.01) * 0.04 / (p + 0.05), ll - 0.5 * (ln(2 * pi()) + ln(p + 0.05) + (y - s) * (y - s) / (p + 0.05)) from f join v on v.l_suppkey = f.l_suppkey and v.t = f.t + 1)
select l_suppkey, max(t) as quarters, round(arg_max(ll, t), 4) as loglik, round(arg_max(s, t), 5) as state from f group by l_suppkey"""
)
def supplier_filters(spark, sf_dir):
    """A level filtered for every supplier's own series, one group a supplier."""
    y = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", quarter_index("l_shipdate").alias("quarter_idx")).agg((F.avg("l_quantity").cast("double") / 25).alias("y"))
    out = statespace.filter_groups(y, "l_suppkey", "quarter_idx", ["y"], LEVEL)
    ends = out.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("quarters"), F.sum("loglik").alias("loglik"), F.max_by(F.col("state")[0], "t").alias("state"))
    return ends.withColumns({"loglik": F.round("loglik", 4), "state": F.round("state", 5)})
