"""Scenario paths, their summaries, and shocks on grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quarters import quarter_index
from ..operators import ingest, scenarios
from .registry import query, table

Q = "(year(o_orderdate) * 4 + quarter(o_orderdate))::int"

COMPONENTS = """select n_regionkey::varchar as scenario, n_name as shock, (n_nationkey % 5 - 2)::double as size_sd, (n_nationkey % 4)::int as start,
 (1 + n_nationkey % 6)::int as duration, 0.5 + (n_nationkey % 3) * 0.2 as decay, 0.2 + (n_nationkey % 2) * 1.8 as scale from nation"""


def components(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("string").alias("scenario"),
        F.col("n_name").alias("shock"),
        F.expr("cast(n_nationkey % 5 - 2 as double)").alias("size_sd"),
        F.expr("cast(n_nationkey % 4 as int)").alias("start"),
        F.expr("cast(1 + n_nationkey % 6 as int)").alias("duration"),
        F.expr("0.5D + (n_nationkey % 3) * 0.2D").alias("decay"),
        F.expr("0.2D + (n_nationkey % 2) * 1.8D").alias("scale"),
    )


PATH = f"with c as ({COMPONENTS}), s as (select *, unnest(generate_series(0, duration - 1)) as k from c), p as (select scenario, shock, (start + k)::int as h, sum(size_sd * decay ** k * scale) as value from s where start + k < 6 group by all)"


@query(f"{PATH} select scenario, shock, h, round(value, 6) as value from p")
def structural_shock_path(spark, sf_dir):
    return scenarios.structural_path(components(spark, sf_dir), 6).select("scenario", "shock", "h", F.round("value", 6).alias("value"))


@query(
    f"""{PATH}, z as (select scenario, shock, h, case when scale > 1e-12 then value / scale else 0 end as z from p join (select distinct scenario, shock, scale from c) using (scenario, shock)),
q as (select scenario, h, max(abs(z)) as single, sqrt(sum(z * z)) as joint from z group by all),
m as (select scenario, max(single) as max_single, max(joint) as max_joint from q group by 1)
select scenario, round(max_single, 6) as max_single, round(max_joint, 6) as max_joint, case when max_single > 8 or max_joint > 8 then 'extreme_extrapolation' when max_single > 4 or max_joint > 4 then 'stress_extrapolation' else 'within_4sd' end as domain from m"""
)
def joint_norm(spark, sf_dir):
    c = components(spark, sf_dir)
    z = scenarios.standardised(scenarios.structural_path(c, 6), c.select("scenario", "shock", "scale").distinct(), ["scenario", "shock"])
    return scenarios.joint_norm(z).withColumns({"max_single": F.round("max_single", 6), "max_joint": F.round("max_joint", 6)})


@query(f"{PATH}, g as (select n_name as shock, h::int as h from nation, generate_series(0, 7) as t(h)), z as (select h, shock, sum(value) as value from p group by all) select h, shock, round(coalesce(value, 0), 6) as value from g left join z using (h, shock)")
def shock_pad_truncate(spark, sf_dir):
    shocks = scenarios.structural_path(components(spark, sf_dir), 6).groupBy("h", "shock").agg(F.sum("value").alias("value"))
    return scenarios.padded(shocks, table(spark, sf_dir, "nation").select(F.col("n_name").alias("shock")), 8).withColumn("value", F.round("value", 6))


@query(
    """with t as (select n_nationkey as scenario, 4.25::double as base, 5.0 + n_nationkey * 0.25 as target, h::int as h from nation, generate_series(0, 19) as g(h))
select scenario, h, round(case when h < 4 then base + (target - base) * h / 3 when h < 8 then target when h < 16 then target + (base - target) * (h - 8) / 7 else base end, 6) as value from t"""
)
def unemployment_path(spark, sf_dir):
    targets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scenario"), F.lit(4.25).alias("base"), F.expr("5.0D + n_nationkey * 0.25D").alias("target"))
    return scenarios.ramp_path(targets, 20).select("scenario", "h", F.round("value", 6).alias("value"))


RATES = f"select o_orderpriority, {Q} as quarter_idx, avg(o_totalprice) / 100000 - 2 as rate from orders group by all"


@query(
    f"""with r as ({RATES}), f as (select o_orderpriority, quarter_idx, greatest(rate, 0.125) / 4 as r0 from r)
select o_orderpriority, quarter_idx, round(r0, 6) as rate0, """
    + ", ".join(f"round(lead(r0, {k}) over w, 6) as rate{k}" for k in range(1, 7))
    + " from f window w as (partition by o_orderpriority order by quarter_idx)"
)
def zlb_conditioning(spark, sf_dir):
    rates = table(spark, sf_dir, "orders").groupBy("o_orderpriority", quarter_index("o_orderdate").alias("quarter_idx")).agg((F.avg("o_totalprice") / 100000 - 2).alias("rate"))
    out = scenarios.floor_conditions(rates, ["o_orderpriority"], "quarter_idx", "rate", 0.125, 6)
    return out.select("o_orderpriority", "quarter_idx", *[F.round(f"rate{k}", 6).alias(f"rate{k}") for k in range(7)])


@query(
    """with d as (select c_nationkey::varchar as scenario, c_mktsegment as variable, c_acctbal / 1000 as deviation from customer)
select scenario, """
    + ", ".join(f'round(min(deviation) filter (where variable = \'{v}\'), 6) as "{v}_min", round(max(deviation) filter (where variable = \'{v}\'), 6) as "{v}_max"' for v in ("BUILDING", "MACHINERY"))
    + " from d group by 1"
)
def scenario_summary(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("scenario"), F.col("c_mktsegment").alias("variable"), (F.col("c_acctbal") / 1000).alias("deviation"))
    out = scenarios.summary(d, ["BUILDING", "MACHINERY"])
    return out.select("scenario", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(f"with h as (select {Q} as quarter_idx, sum(o_totalprice::decimal(18,2))::double / count(o_totalprice) as value from orders group by 1) select n_nationkey as draw, quarter_idx, round(value, 4) as value from h, nation")
def history_broadcast(spark, sf_dir):
    """One history beside every draw: both sides are dimension tables (quarters and draws)."""
    h = table(spark, sf_dir, "orders").groupBy(quarter_index("o_orderdate").alias("quarter_idx")).agg(F.round(ingest.exact_mean("o_totalprice"), 4).alias("value"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("draw")).crossJoin(h)
