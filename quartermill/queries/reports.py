"""What figures, tables and comparisons show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transforms as T
from ..functions.quarters import quarter_index
from ..operators import bands, compare, frames, ingest
from ..sources import archives
from .registry import query, table
from .series import BY_PRIORITY, orders_by_priority
from .tables import STACK, by_priority

BANDS = "select l_returnflag as variable, l_linenumber as h, sum(l_extendedprice::decimal(18,2))::double / count(*) as mean, min(l_extendedprice) as lower, max(l_extendedprice) as upper from lineitem group by all"


def _bands(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("variable"), F.col("l_linenumber").alias("h")).agg(ingest.exact_mean("l_extendedprice").alias("mean"), F.min("l_extendedprice").alias("lower"), F.max("l_extendedprice").alias("upper"))


@query(f"with b as ({BANDS}) select variable, h, unnest(['mean', 'lower', 'upper']) as statistic, round(unnest([mean, lower, upper]), 4) as value from b")
def baseline_band_frame(spark, sf_dir):
    return frames.band_frame(_bands(spark, sf_dir), ["variable", "h"]).withColumn("value", F.round("value", 4))


@query(f"with b as ({BANDS}) select variable, h, round(mean, 4) as mean, round(mean, 4) as lower, round(mean, 4) as upper from b")
def bands_without_samples(spark, sf_dir):
    out = frames.without_samples(_bands(spark, sf_dir).select("variable", "h", F.col("mean").alias("value")), "value")
    return out.select("variable", "h", *[F.round(c, 4).alias(c) for c in ("mean", "lower", "upper")])


@query(f"with b as ({BANDS}), s as (select variable, min(mean) as lo, max(mean) as hi from b group by 1) select variable, h, round(mean, 4) as mean, round(lo - (hi - lo) * 0.05, 4) as axis_low, round(hi + (hi - lo) * 0.05, 4) as axis_high from b join s using (variable)")
def policy_panel_range(spark, sf_dir):
    out = frames.panel_range(_bands(spark, sf_dir), ["h"], "variable", "mean")
    return out.select("variable", "h", *[F.round(c, 4).alias(c) for c in ("mean", "axis_low", "axis_high")])


@query(
    """with r as (select s_nationkey as scenario, s_name as scenario_label, 'v' || (s_suppkey % 4)::varchar as variable, s_suppkey as horizon, s_acctbal as deviation from supplier), g as (select scenario, min(scenario_label) as legend from r group by 1)
select scenario, legend, variable, horizon, deviation from r join g using (scenario) where variable in ('v1', 'v2')"""
)
def scenario_panel(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scenario"), F.col("s_name").alias("scenario_label"), F.expr("'v' || (s_suppkey % 4)").alias("variable"), F.col("s_suppkey").alias("horizon"), F.col("s_acctbal").alias("deviation"))
    return frames.scenario_panel(r, ["v1", "v2"])


DRIVERS = ["3-MEDIUM", "1-URGENT", "5-LOW"]


@query(
    f"""with s as ({STACK}), d as (select *, case o_orderpriority when '3-MEDIUM' then 0 when '1-URGENT' then 1 else 2 end as place from s where o_orderpriority in ('3-MEDIUM', '1-URGENT', '5-LOW'))
select quarter_idx, o_orderpriority as driver, round(value, 3) + 0.0::double as value, round(coalesce(case when value >= 0 then sum(greatest(value, 0)) over w else sum(least(value, 0)) over w end, 0), 2) + 0.0::double as base
from d window w as (partition by quarter_idx order by place rows between unbounded preceding and 1 preceding)"""
)
def driver_stacks(spark, sf_dir):
    from ..operators.reshape import wide

    mean = table(spark, sf_dir, "orders").agg(F.avg("o_totalprice").alias("m"))
    rows = by_priority(spark, sf_dir).crossJoin(F.broadcast(mean)).withColumn("value", F.col("value") - F.col("m"))  # one row
    out = frames.driver_stacks(wide(rows, ["quarter_idx"], "o_orderpriority", "value", DRIVERS), "quarter_idx", DRIVERS).where("value is not null")
    return out.select("quarter_idx", "driver", (F.round("value", 3) + F.lit(0.0)).alias("value"), (F.round("base", 2) + F.lit(0.0)).alias("base"))


@query(f"with q as ({BY_PRIORITY}), b as (select o_orderpriority, quarter_idx, value, case when quarter_idx < 7990 then 'history' else 'forecast' end as part from q) select o_orderpriority, quarter_idx, round(value, 4) as value, part, (row_number() over (partition by o_orderpriority order by part desc, quarter_idx) - 1)::bigint as x from b")
def history_forecast_panel(spark, sf_dir):
    q = orders_by_priority(spark, sf_dir)
    out = frames.history_and_forecast(q.where("quarter_idx < 7990"), q.where("quarter_idx >= 7990"), ["o_orderpriority"], "quarter_idx")
    return out.select("o_orderpriority", "quarter_idx", F.round("value", 4).alias("value"), "part", F.col("x").cast("long").alias("x"))


@query(
    f"""with q as ({BY_PRIORITY}), b as (select o_orderpriority, quarter_idx, value / 1e5 as base, 0.1 * (quarter_idx % 5) as r from q)
select o_orderpriority, quarter_idx, round(400 * (exp((base + r) / 100) - 1) - 400 * (exp(base / 100) - 1), 6) as response from b"""
)
def response_report_units(spark, sf_dir):
    q = orders_by_priority(spark, sf_dir)
    base = q.select("o_orderpriority", "quarter_idx", (F.col("value") / 1e5).alias("base"))
    resp = q.select("o_orderpriority", "quarter_idx", F.expr("0.1D * (quarter_idx % 5)").alias("response"))
    return frames.response_rows(base, resp, ["o_orderpriority", "quarter_idx"], T.growth_to_annual_percent).withColumn("response", F.round("response", 6))


@query(f"with q as ({BY_PRIORITY}), k as (select o_orderpriority, max(quarter_idx) filter (where quarter_idx % 3 <> 0) as last, arg_max(value, quarter_idx) filter (where quarter_idx % 3 <> 0) as value from q group by 1) select o_orderpriority, h::int as h, round(value, 4) as value, last >= 8000 as current from k, generate_series(0, 3) as g(h)")
def unemployment_baseline(spark, sf_dir):
    q = orders_by_priority(spark, sf_dir).withColumn("value", F.expr("case when quarter_idx % 3 <> 0 then value end"))
    return frames.last_known(q, ["o_orderpriority"], "quarter_idx", "value", 4, 8000).withColumn("value", F.round("value", 4))


@query("select o_orderkey, case o_orderkey % 3 when 0 then 'observables' else 'history_states' end as kind from orders where o_orderkey % 3 <> 2")
def requested_outputs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("case o_orderkey % 3 when 0 then 'observables' when 1 then 'history_states' else 'states' end").alias("kind"))
    return frames.requested(rows, ["forecastobs", "histstates"])


@query(
    """with a as (select p_brand as "array", p_size::bigint as i, p_partkey as j, p_retailprice as x from part where p_size < 25), d as (select p_brand as "array", p_size::bigint as i, p_partkey as j, p_retailprice as y from part where p_size < 25 and p_brand not in ('Brand#11', 'Brand#12') union all select 'only', 1, 1, 2.0),
b as (select coalesce(a."array", d."array") as "array", a."array" is null as no_a, d."array" is null as no_d from a full join d on a."array" = d."array" and a.i = d.i and a.j = d.j)
select "array", case when "array" = 'Brand#11' then 'missing_oracle' when bool_and(no_d) then 'extra_candidate' when bool_and(no_a) then 'missing_candidate' when bool_or(no_a or no_d) then 'mismatch' else 'match' end as status,
 case when not bool_and(no_a) and not bool_and(no_d) then 0.0::double end as max_abs from b group by 1
union all select 'never', 'missing_oracle', null"""
)
def folder_compare(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_brand").alias("array"), F.col("p_size").cast("long").alias("i"), F.col("p_partkey").cast("long").alias("j"), F.col("p_retailprice").alias("value"))
    extra = spark.range(1).select(F.lit("only").alias("array"), F.lit(1).cast("long").alias("i"), F.lit(1).cast("long").alias("j"), F.lit(2.0).alias("value"))
    return compare.compare_folders(p.where(~F.col("array").isin("Brand#11", "Brand#12")).unionByName(extra), p, ["Brand#11", "Brand#13", "never"])


HELD = ("sampler/mhparams", "sampler/fixed", "sampler/proposal_covariance", "sampler/log_posterior", "kalman/filtered_states")


@query(
    f"""with need as (select unnest([{", ".join(f"{{'profile': '{p}', 'array': '{a}'}}" for p, arrays in compare.COVERAGE.items() for a in arrays)}]) as n), have as (select list_extract([{", ".join(f"'{a}'" for a in HELD)}], (r_regionkey + 1)::int) as a from region)
select n.profile as profile, n.array as "array" from need where n.array not in (select a from have)"""
)
def fixture_coverage(spark, sf_dir):
    """Arrays that the fixtures at hand lack, for each of the sixteen profiles."""
    have = table(spark, sf_dir, "region").select(F.element_at(F.array(*map(F.lit, HELD)), F.expr("cast(r_regionkey + 1 as int)")).alias("array"))
    return compare.coverage(have)


@query(
    """with a as (select c_custkey as draw, c_acctbal as x from customer), d as (select c_custkey as draw, c_acctbal + case when c_custkey % 500 = 1 then 0.5 else 0 end as x from customer where c_custkey % 700 <> 70)
select 'logpost' as "array", count(*) as cells, (count(*) - count(d.draw))::bigint as one_sided, false as passed, case when count(d.draw) = count(*) then round(max(abs(a.x - d.x)), 6) end as max_abs from a left join d using (draw)"""
)
def trace_compare(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("draw"), F.col("c_acctbal").alias("logpost"))
    d = a.where("draw % 700 <> 70").withColumn("logpost", F.expr("logpost + case when draw % 500 = 1 then 0.5D else 0 end"))
    return compare.compare_traces(a, d, ["draw"], ["logpost"], "forecast").select("array", "cells", "one_sided", F.when(F.col("max_abs") < F.lit(float("inf")), F.round("max_abs", 6)).alias("max_abs"), "passed")


@query("select n_name as machine, 'k' || (s_suppkey % 3)::varchar as kernel, s_name as backend, round(abs(s_acctbal), 2) as elapsed_seconds, s_acctbal > 0 as available from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 3 = 1")
def bench_report_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    result = F.struct(
        F.expr("'k' || (s_suppkey % 3)").alias("kernel"), F.col("s_name").alias("backend"), F.lit("cpu").alias("device"), F.lit(40).alias("horizon"), F.lit(3).alias("repeats"), F.lit("float64").alias("dtype"),
        F.round(F.abs("s_acctbal"), 2).alias("elapsed_seconds"), F.lit(False).alias("skipped"), F.expr("s_acctbal > 0").alias("available"), F.lit(None).cast("string").alias("reason"),
    )
    reports = s.groupBy(F.col("n_name").alias("machine")).agg(F.collect_list(result).alias("results")).withColumn("command", F.create_map(F.lit("draws"), F.lit("8")))
    return compare.bench_rows(reports, "k1").select("machine", "kernel", "backend", "elapsed_seconds", "available")


DECOMPOSED = """with d as (select n_regionkey as t, c_mktsegment as variable, n_name as shock, avg(c_acctbal) / 1e4 as value from customer join nation on c_nationkey = n_nationkey group by all),
b as (select t, variable, 0.1 * (t + 1) as baseline, sum(value) as sv from d group by all), p as (select t, variable, baseline, baseline + sv as smoothed, baseline + sv + 0.05 * t as observed from b),
r as (select t, variable, baseline, 400 * (exp(smoothed / 100) - 1) / smoothed as scale, 400 * (exp(smoothed / 100) - 1) as smoothed, 400 * (exp(observed / 100) - 1) as observed from p where t > 1),
g as (select t, variable, case when shock < 'NATION_15' then 'demand' else 'supply' end as driver, sum(value) as value from d group by all)"""


def _decomposition(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    d = c.groupBy(F.col("n_regionkey").alias("t"), F.col("c_mktsegment").alias("variable"), F.col("n_name").alias("shock")).agg((F.avg("c_acctbal") / 1e4).alias("value"))
    groups = table(spark, sf_dir, "nation").select(F.col("n_name").alias("shock"), F.expr("case when n_name < 'NATION_15' then 'demand' else 'supply' end").alias("driver"))
    paths = d.groupBy("t", "variable").agg(F.sum("value").alias("sv")).select("t", "variable", F.expr("0.1D * (t + 1)").alias("baseline"), F.expr("0.1D * (t + 1) + sv").alias("smoothed"), F.expr("0.1D * (t + 1) + sv + 0.05D * t").alias("observed"))
    return bands.report_decomposition(d, groups, paths, T.growth_to_annual_percent, tail=3)


@query(
    f"""{DECOMPOSED} select t, variable, driver, round(value * scale, 6) as contribution, round(smoothed, 6) as smoothed, round(observed, 6) as observed from g join r using (t, variable)
union all select t, variable, 'Initial conditions and trend', round(baseline * scale, 6), round(smoothed, 6), round(observed, 6) from r
union all select t, variable, 'Observed-model residual', round(observed - smoothed, 6), round(smoothed, 6), round(observed, 6) from r"""
)
def report_decomposition(spark, sf_dir):
    return _decomposition(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("contribution", "smoothed", "observed")})


@query(
    f"""{DECOMPOSED}, a as (select t, variable, value * scale as x from g join r using (t, variable) union all select t, variable, baseline * scale from r union all select t, variable, observed - smoothed from r),
s as (select t, variable, sum(x) as x from a group by all) select max(abs(s.x - r.observed)) < 1e-5 as reconciled from s join r using (t, variable)"""
)
def decomposition_reconciled(spark, sf_dir):
    return bands.reconciliation(_decomposition(spark, sf_dir)).select((F.col("max_error") < 1e-5).alias("reconciled"))


@query("select n_name as shock, case n_nationkey % 4 when 0 then 0 else 2 end::bigint as groups from nation where n_nationkey % 4 in (0, 1)")
def shock_group_faults(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    one = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("shock"), F.lit("a").alias("driver"))
    two = n.where("n_nationkey % 4 = 1").select(F.col("n_name").alias("shock"), F.lit("b").alias("driver"))
    return bands.group_faults(n.select(F.col("n_name").alias("shock")), one.unionByName(two))


@query(
    """with t as (select c_mktsegment as chain, c_custkey as draw, case when c_custkey % 50 = 3 then null else c_acctbal end as logpost from customer where c_custkey % 40 <> 7),
b as (select chain, count(*) filter (where logpost is null) as bad, max(draw) - min(draw) + 1 - count(*) as gaps from t group by 1) select chain, bad::bigint as bad, 0::bigint as repeated, gaps::bigint as gaps from b where bad > 0 or gaps > 0"""
)
def trace_faults(spark, sf_dir):
    t = table(spark, sf_dir, "customer").where("c_custkey % 40 <> 7").select(F.col("c_mktsegment").alias("chain"), F.col("c_custkey").alias("draw"), F.expr("case when c_custkey % 50 <> 3 then c_acctbal end").alias("logpost"), F.lit(True).alias("accepted"))
    return archives.trace_faults(t).withColumn("repeated", F.col("repeated").cast("long"))


@query("select n_name as array, 0 as ord, case when n_nationkey % 2 = 0 then 'new' else 'old' end as label from nation union all select n_name, 1, 'old2' from nation where n_nationkey % 2 = 1")
def manifest_merge(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    label = lambda df, i, x: df.select(F.col("n_name").alias("array"), F.lit(i).alias("ord"), F.lit(x).alias("label"))
    return archives.merged_labels(label(n, 0, "old").unionByName(label(n, 1, "old2")), label(n.where("n_nationkey % 2 = 0"), 0, "new"))


@query(
    "select p_partkey, try_cast(p_brand as double) as number, case when p_size % 3 = 0 then true when p_size % 3 = 1 then false end as flag, p_size::bigint as whole from part"
)
def metadata_scalars(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("t", F.expr("case p_size % 3 when 0 then 'True' when 1 then '0' else 'maybe' end"))
    return p.select("p_partkey", archives.scalar("p_brand", "double").alias("number"), archives.scalar("t", "boolean").alias("flag"), archives.scalar(F.concat(F.col("p_size").cast("string"), F.lit(".0")), "bigint").alias("whole"))


@query(
    """with o as (select (year(o_orderdate) * 4 + quarter(o_orderdate))::int as q, sum(o_totalprice::decimal(18,2))::double / count(*) / 1000 as y from orders group by 1), l as (select (year(l_shipdate) * 4 + quarter(l_shipdate))::int as q, sum(l_extendedprice::decimal(18,2))::double / count(*) / 1000 as x from lineitem group by 1),
d as (select q, y - lag(y) over (order by q) as y, x - lag(x) over (order by q) as x from o join l using (q))
select round(regr_intercept(y, x), 6) as intercept, round(regr_slope(y, x), 6) as slope, round(regr_r2(y, x), 6) as r2, regr_count(y, x)::bigint as n, case when count(*) filter (where q < 7996 and y is not null) >= 20 then round(regr_slope(y, x) filter (where q < 7996), 6) end as slope_early,
 (regr_count(y, x) filter (where q < 7996))::bigint as n_early, case when count(*) filter (where q >= 7984 and y is not null) >= 20 then round(regr_slope(y, x) filter (where q >= 7984), 6) end as slope_late, (regr_count(y, x) filter (where q >= 7984))::bigint as n_late from d"""
)
def hours_bridge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(quarter_index("o_orderdate").alias("q")).agg((ingest.exact_mean("o_totalprice") / 1000).alias("y"))
    l = table(spark, sf_dir, "lineitem").groupBy(quarter_index("l_shipdate").alias("q")).agg((ingest.exact_mean("l_extendedprice") / 1000).alias("x"))  # noqa: E741
    out = ingest.hours_bridge(o.join(l, "q").withColumn("s", F.lit(1)), ["s"], "q", "y", "x", 7996, 7984)
    return out.select(*[F.round(c, 6).alias(c) if not c.startswith("n") else c for c in out.columns])
