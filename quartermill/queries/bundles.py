"""What report bundles hold, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quarters import quarter_index
from ..operators import bundles
from .registry import query, table
from .series import BY_PRIORITY, orders_by_priority

FLAGS = ("A", "N", "R")

RESPONSES = "select l_linenumber - 1 as h, l_returnflag as variable, 's' || (l_suppkey % 7)::varchar as shock, round(sum(l_discount - 0.05), 6)::double as response from lineitem group by all"


def responses(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("h"), F.col("l_returnflag").alias("variable"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("shock"))
    return r.agg(F.round(F.sum(F.col("l_discount") - 0.05), 6).cast("double").alias("response"))


@query(
    f"""with r as ({RESPONSES}), s as (select shock, row_number() over (order by round(sum(abs(response)), 9) desc, shock) as mover from r group by shock)
select variable, shock, h, round(response, 5) + 0.0 as response, mover::int as mover from r join s using (shock) where mover <= 4"""
)
def response_report(spark, sf_dir):
    """Responses of the four shocks that move most."""
    out = bundles.response_lines(responses(spark, sf_dir), 4)
    return out.withColumn("response", F.round("response", 5) + F.lit(0.0))


@query(f"with r as ({RESPONSES}), s as (select shock from r group by shock order by round(sum(abs(response)), 9) desc, shock limit 4) select variable, h, round(sum(response), 4) + 0.0 as response from r semi join s using (shock) group by all")
def response_panel(spark, sf_dir):
    return bundles.response_panel(bundles.response_lines(responses(spark, sf_dir), 4)).withColumn("response", F.round("response", 4) + F.lit(0.0))


@query("select 'flag ' || l_returnflag as flag, l_linenumber, count(*) as n from lineitem group by all")
def labelled_axis(spark, sf_dir):
    """Positions of an axis replaced by its labels, after checking that both are equally many."""
    place = F.array_position(F.array(*map(F.lit, FLAGS)), F.col("l_returnflag")) - 1
    rows = table(spark, sf_dir, "lineitem").groupBy(place.alias("place"), "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return bundles.labelled(rows, "place", [f"flag {f}" for f in FLAGS], "flag")


PARTS = """select (year(l_shipdate) * 4 + quarter(l_shipdate))::int as t, l_returnflag as variable, l_linestatus as driver, round(sum(l_discount)::double, 6) as contribution from lineitem group by all"""


@query(
    f"""with p as ({PARTS}), s as (select variable, driver, avg(abs(contribution)) as size from p group by all)
select variable, driver, round(size, 4) as size, round(size / sum(size) over (partition by variable), 5) as share, (row_number() over (partition by variable order by size desc, driver))::int as place from s"""
)
def decomposition_report(spark, sf_dir):
    """Drivers of each variable by size, once they are known to add up to what was observed."""
    p = table(spark, sf_dir, "lineitem").groupBy(quarter_index("l_shipdate").alias("t"), F.col("l_returnflag").alias("variable"), F.col("l_linestatus").alias("driver")).agg(F.round(F.sum("l_discount").cast("double"), 6).alias("contribution"))
    observed = p.groupBy("t", "variable").agg(F.sum("contribution").alias("observed"))
    gated = bundles.reconciled(p.join(observed, ["t", "variable"]))
    return bundles.driver_shares(gated).withColumns({"size": F.round("size", 4), "share": F.round("share", 5)})


@query(
    f"""with q as ({BY_PRIORITY}), h as (select o_orderpriority as variable, quarter_idx, value from q where quarter_idx < 7988), l as (select variable, max(quarter_idx) as m from h group by 1),
a as (select variable, quarter_idx, 'history' as part, value, value as lower, value as upper from h join l using (variable) where quarter_idx > m - 6),
b as (select o_orderpriority as variable, quarter_idx, 'forecast' as part, value, value * 0.9 as lower, value * 1.1 as upper from q where quarter_idx >= 7988)
select variable, quarter_idx, part, (row_number() over (partition by variable order by part = 'forecast', quarter_idx) - 1)::int as x, round(value, 2) as value, round(lower, 2) as lower, round(upper, 2) as upper from (select * from a union all select * from b)"""
)
def forecast_report(spark, sf_dir):
    """The last quarters of history and the bands after them, one line a variable."""
    q = orders_by_priority(spark, sf_dir).withColumnRenamed("o_orderpriority", "variable")
    ahead = q.where("quarter_idx >= 7988").select("variable", "quarter_idx", F.col("value").alias("mean"), (F.col("value") * 0.9).alias("lower"), (F.col("value") * 1.1).alias("upper"))
    out = bundles.forecast_panel(q.where("quarter_idx < 7988"), ahead, tail=6)
    return out.withColumns({c: F.round(c, 2) for c in ("value", "lower", "upper")})


STRESS = "select n_nationkey / 2.0::double as target, h::int as h, 3.0 + least(h, 4) * (n_nationkey / 2.0 - 3) / 4 as value, 3.0::double as baseline from nation, generate_series(0, 7) as g(h)"


def stress(spark, sf_dir):
    t = table(spark, sf_dir, "nation").select((F.col("n_nationkey") / 2.0).alias("target"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("h"))
    return t.select("target", "h", (3.0 + F.least("h", F.lit(4)) * (F.col("target") - 3) / 4).alias("value"), F.lit(3.0).alias("baseline"))


@query(
    f"""with p as ({STRESS}), r as (select *, row_number() over (partition by target order by abs(value - 3) desc, h) as n from p)
select target, round(max(value) filter (where n = 1), 6) as peak, max(h) filter (where n = 1) as peak_h, round(avg(value - 3), 6) + 0.0 as mean_deviation, min(h) filter (where value >= target - 1e-9) as reached_h from r group by target"""
)
def stress_report(spark, sf_dir):
    return bundles.stress_table(stress(spark, sf_dir)).withColumns({"peak": F.round("peak", 6), "mean_deviation": F.round("mean_deviation", 6) + F.lit(0.0)})


@query(f"with p as ({STRESS}) select target, 'value' as line, h, round(value, 6) as value from p union all select target, 'baseline', h, baseline from p")
def stress_lines(spark, sf_dir):
    return bundles.study_lines(stress(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    f"with q as ({BY_PRIORITY}), a as (select o_orderpriority, quarter_idx, value from q), d as (select o_orderpriority, quarter_idx, round(value / 2, 4) as half from q) select a.o_orderpriority, a.quarter_idx, round(value - 2 * half, 2) + 0.0 as rest from a join d using (o_orderpriority, quarter_idx)"
)
def parallel_rows(spark, sf_dir):
    """Two tables side by side, after checking that their quarters are the same."""
    q = orders_by_priority(spark, sf_dir)
    half = q.select("o_orderpriority", "quarter_idx", F.round(F.col("value") / 2, 4).alias("half"))
    out = bundles.in_parallel(q.select("o_orderpriority", "quarter_idx", "value"), half, ["o_orderpriority"], "quarter_idx")
    return out.select("o_orderpriority", "quarter_idx", (F.round(F.col("value") - 2 * F.col("half"), 2) + F.lit(0.0)).alias("rest"))


@query(f"with q as ({BY_PRIORITY}) select (row_number() over (order by quarter_idx) - 1)::int as place, quarter_idx, round(value, 2) as value from q where o_orderpriority = '1-URGENT'")
def ordered_quarters(spark, sf_dir):
    """One series' quarters, known to be there once each and ascending."""
    q = orders_by_priority(spark, sf_dir).where("o_orderpriority = '1-URGENT'").withColumn("place", F.expr("cast(row_number() over (order by quarter_idx) - 1 as int)"))
    return bundles.in_order(q, "place", "quarter_idx").select("place", "quarter_idx", F.round("value", 2).alias("value"))
