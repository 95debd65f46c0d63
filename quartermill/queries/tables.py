"""Reshaping, ranking, comparison, accounting and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transforms as T
from ..functions.quarters import quarter_index
from ..operators import accounting, bands, compare, ingest, reshape
from ..sources import vintages
from .registry import query, table

Q = "(year(o_orderdate) * 4 + quarter(o_orderdate))::int"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
WIDE = ", ".join(f"round(max(value) filter (where o_orderpriority = '{p}'), 4) as \"{p}\"" for p in PRIORITIES)
BY = f"select o_orderpriority, {Q} as quarter_idx, sum(o_totalprice::decimal(18,2))::double / count(o_totalprice) as value from orders group by all"


def by_priority(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", quarter_index("o_orderdate").alias("quarter_idx")).agg(ingest.exact_mean("o_totalprice").alias("value"))


@query(f"with q as ({BY}) select quarter_idx, {WIDE} from q group by quarter_idx")
def pivot_wide(spark, sf_dir):
    w = reshape.wide(by_priority(spark, sf_dir), ["quarter_idx"], "o_orderpriority", "value", PRIORITIES)
    return w.select("quarter_idx", *[F.round(f"`{p}`", 4).alias(p) for p in PRIORITIES])


@query("select l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) as variable, unnest([l_quantity, l_discount, l_tax]) as value from lineitem")
def unpivot_long(spark, sf_dir):
    return reshape.long(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def keep_last_dedup(spark, sf_dir):
    return reshape.keep_last(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("select o_orderpriority, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1")
def distinct_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return reshape.first_per(rows, ["o_orderpriority"], "at", "o_orderkey")


@query(
    """with s as (select s_nationkey, l_suppkey, sum(abs(l_extendedprice * l_discount)) as score from lineitem join supplier on l_suppkey = s_suppkey group by all)
select s_nationkey, l_suppkey, round(score, 2) as score, row_number() over (partition by s_nationkey order by score desc, l_suppkey) as rank from s qualify rank <= 6"""
)
def topk_movers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey")).withColumn("v", F.expr("l_extendedprice * l_discount"))
    return reshape.top_k(rows, ["s_nationkey"], "l_suppkey", "v", 6).withColumn("score", F.round("score", 2)).withColumn("rank", F.col("rank").cast("long"))


@query(
    """with s as (select l_returnflag, p_brand, sum(abs(l_tax - 0.04)) as score, sum(l_tax - 0.04) as total from lineitem join part on l_partkey = p_partkey group by all),
r as (select *, row_number() over (partition by l_returnflag order by score desc, p_brand) as nth from s)
select l_returnflag, case when nth <= 5 then p_brand else 'other' end as p_brand, round(sum(total), 6) + 0.0::double as total from r group by 1, 2"""
)
def topk_with_other(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey")).withColumn("v", F.expr("l_tax - 0.04D"))
    return reshape.top_k_and_rest(rows, ["l_returnflag"], "p_brand", "v", 5).withColumn("total", F.round("total", 6) + F.lit(0.0))


@query(f"with q as ({BY}) select o_orderpriority, quarter_idx, round(value, 4) as value from q qualify row_number() over (partition by o_orderpriority order by quarter_idx desc) <= 8")
def tail_n_periods(spark, sf_dir):
    return reshape.tail(by_priority(spark, sf_dir), ["o_orderpriority"], "quarter_idx", 8).withColumn("value", F.round("value", 4))


@query("select s_suppkey as id, 'supplier' as kind, s_acctbal as value, s_nationkey as nation from supplier union all select c_custkey, 'customer', c_acctbal, c_nationkey from customer")
def append_scenarios(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("value"), F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("value"), F.col("c_nationkey").alias("nation"))
    return s.unionByName(c)


@query(
    """select c_nationkey as nation, 'missing' as side from (select distinct c_nationkey from customer) where c_nationkey not in (select s_nationkey from supplier)
union all select s_nationkey, 'extra' from (select distinct s_nationkey from supplier) where s_nationkey not in (select c_nationkey from customer)"""
)
def set_difference(spark, sf_dir):
    return reshape.set_difference(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), "nation")


STACK = f"select {Q} as quarter_idx, o_orderpriority, avg(o_totalprice) - (select avg(o_totalprice) from orders) as value from orders group by all"


@query(
    f"""with s as ({STACK})
select quarter_idx, o_orderpriority, round(value, 4) as value, round(coalesce(case when value >= 0 then sum(greatest(value, 0)) over w else sum(least(value, 0)) over w end, 0), 3) as base
from s window w as (partition by quarter_idx order by o_orderpriority rows between unbounded preceding and 1 preceding)"""
)
def stacked_bar_bases(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    mean = orders.agg(F.avg("o_totalprice").alias("m"))
    rows = by_priority(spark, sf_dir).crossJoin(F.broadcast(mean)).withColumn("value", F.col("value") - F.col("m"))  # one row
    return reshape.stacked(rows, ["quarter_idx"], "o_orderpriority", "value").select("quarter_idx", "o_orderpriority", F.round("value", 4).alias("value"), F.round("base", 3).alias("base"))


@query("select l_returnflag, l_linenumber, round(sum(l_extendedprice::decimal(18,2))::double / count(l_extendedprice), 4) as mean, round(quantile_cont(l_extendedprice, 0.05), 4) as lower, round(quantile_cont(l_extendedprice, 0.95), 4) as upper from lineitem group by all")
def mean_bands(spark, sf_dir):
    b = bands.bands(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], "l_extendedprice", places=2)
    return b.select("l_returnflag", "l_linenumber", *[F.round(x, 4).alias(x) for x in ("mean", "lower", "upper")])


@query(
    """with g as (select l_returnflag, l_linenumber, l_discount * 100 as x from lineitem),
a as (select l_returnflag, l_linenumber, 'each sample' as transformed, avg(400 * (exp(x / 100) - 1)) as mean, quantile_cont(400 * (exp(x / 100) - 1), 0.05) as lower, quantile_cont(400 * (exp(x / 100) - 1), 0.95) as upper from g group by all),
b as (select l_returnflag, l_linenumber, avg(x) as m, quantile_cont(x, 0.05) as lo, quantile_cont(x, 0.95) as hi from g group by all)
select l_returnflag, l_linenumber, transformed, round(mean, 6) as mean, round(lower, 6) as lower, round(upper, 6) as upper from a
union all select l_returnflag, l_linenumber, 'the bands', round(400 * (exp(m / 100) - 1), 6), round(400 * (exp(lo / 100) - 1), 6), round(400 * (exp(hi / 100) - 1), 6) from b"""
)
def bands_transform_order(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", (F.col("l_discount") * 100).alias("x"))
    keys = ["l_returnflag", "l_linenumber"]
    a = bands.transformed_bands(rows, keys, "x", "loggrowth_to_pct_annualized").withColumn("transformed", F.lit("each sample"))
    b = bands.bands_then_transform(rows, keys, "x", "loggrowth_to_pct_annualized").withColumn("transformed", F.lit("the bands"))
    return a.unionByName(b).select(*keys, "transformed", *[F.round(x, 6).alias(x) for x in ("mean", "lower", "upper")])


CONTRIBUTION = """with d as (select n_regionkey as t, n_name as shock, c_mktsegment, avg(c_acctbal) / 1e4 as value from customer join nation on c_nationkey = n_nationkey group by all),
g as (select t, c_mktsegment, case when shock < 'G' then 'demand' when shock < 'N' then 'supply' else 'policy' end as driver, sum(value) as value from d group by all),
s as (select t, c_mktsegment, sum(value) as total from g group by all)"""


@query(
    f"""{CONTRIBUTION} select t, c_mktsegment, driver, round(value * case when abs(total) > 1e-10 then 400 * (exp(total / 100) - 1) / total else 400 * (exp(1e-7 / 100) - 1) / 1e-7 end, 6) as contribution
from g join s using (t, c_mktsegment)"""
)
def grouped_contributions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    d = c.groupBy(F.col("n_regionkey").alias("t"), F.col("n_name").alias("shock"), "c_mktsegment").agg((F.avg("c_acctbal") / 1e4).alias("value"))
    groups = table(spark, sf_dir, "nation").select(F.col("n_name").alias("shock"), F.expr("case when n_name < 'G' then 'demand' when n_name < 'N' then 'supply' else 'policy' end").alias("driver"))
    return bands.grouped_contributions(d, groups, ["t", "c_mktsegment"], T.growth_to_annual_percent).withColumn("contribution", F.round("contribution", 6))


CPI = f"""with t as (select {Q} as quarter_idx, sum(o_totalprice) as total from orders group by 1),
p as (select {Q} as quarter_idx, o_orderpriority, sum(o_totalprice) as part from orders group by 1, 2),
w as (select quarter_idx, 100 as headline, """ + ", ".join(f"round(100 * max(part) filter (where o_orderpriority = '{x}') / max(total), 1) as e{i}" for i, x in enumerate(PRIORITIES)) + " from p join t using (quarter_idx) group by quarter_idx)"
PARTS = [f"e{i}" for i in range(len(PRIORITIES))]
SUM_PARTS = " + ".join(f"coalesce({p}, 0)" for p in PARTS)


def effects(spark, sf_dir):
    shares = table(spark, sf_dir, "orders").groupBy(quarter_index("o_orderdate").alias("quarter_idx"))
    picks = [F.sum(F.when(F.col("o_orderpriority") == x, F.col("o_totalprice"))).alias(f"p{i}") for i, x in enumerate(PRIORITIES)]
    rows = shares.agg(F.sum("o_totalprice").alias("total"), *picks)
    return rows.select("quarter_idx", F.lit(100.0).alias("headline"), *[F.round(100 * F.col(f"p{i}") / F.col("total"), 1).alias(f"e{i}") for i in range(len(PRIORITIES))])


DRIVERS = "coalesce(e0, 0) + coalesce(e1, 0) + coalesce(e2, 0) + coalesce(e4, 0) / 4 + (coalesce(e3, 0) + coalesce(e4, 0) - coalesce(e4, 0) / 4)"


@query(
    f"""{CPI} select quarter_idx, round({SUM_PARTS}, 6) + 0.0::double as sum_of_parts, round(headline - ({SUM_PARTS}), 6) + 0.0::double as residual, round(coalesce(e3, 0) + 0.75 * coalesce(e4, 0), 6) + 0.0::double as other,
 abs(headline - ({SUM_PARTS})) <= 0.15 as residual_ok, abs({DRIVERS} + headline - ({SUM_PARTS}) - headline) <= 1e-10 as reconciles from w"""
)
def cpi_accounting(spark, sf_dir):
    """Published parts, with one part of `services` split out and the rest of it as another driver, against the headline."""
    rows = effects(spark, sf_dir).select("quarter_idx", "headline", "e0", "e1", "e2", (F.coalesce("e3", F.lit(0.0)) + F.coalesce("e4", F.lit(0.0))).alias("services"), (F.coalesce("e4", F.lit(0.0)) / 4).alias("shelter"))
    out = accounting.accounting(rows, "headline", ["e0", "e1", "e2", "services"], {"services": "shelter"}, tolerance=0.15)
    return out.select("quarter_idx", *[(F.round(x, 6) + F.lit(0.0)).alias(x) for x in ("sum_of_parts", "residual")], (F.round("services_other", 6) + F.lit(0.0)).alias("other"), "residual_ok", "reconciles")


@query(f"{CPI} select quarter_idx, round(coalesce(e0, 0) - coalesce(e1, 0), 6) + 0.0::double as e0_rest, round(headline - (coalesce(e2, 0) + coalesce(e3, 0)), 6) + 0.0::double as headline_rest from w")
def cpi_detail_residuals(spark, sf_dir):
    out = accounting.detail_residuals(effects(spark, sf_dir), {"e0": ["e1"], "headline": ["e2", "e3"]})
    return out.select("quarter_idx", (F.round("e0_rest", 6) + F.lit(0.0)).alias("e0_rest"), (F.round("headline_rest", 6) + F.lit(0.0)).alias("headline_rest"))


@query(
    """with r as (select l_returnflag || l_linestatus as "array", l_orderkey as i, l_linenumber as j, l_quantity::double as v, l_tax::double as tax from lineitem),
a as (select "array", i, j, v as x from r where not ("array" = 'AF' and j = 3)),
d as (select "array", i, j, v * case when i % 100 = 1 then 1 + tax when i % 100 = 2 and "array" = 'RF' then 1.105 when i % 100 = 2 then 0.905 else 1 end as y from r where not ("array" = 'AF' and j = 4) and not ("array" = 'NF' and j = 7)),
b as (select coalesce(a."array", d."array") as "array", coalesce(a.i, d.i) as i, coalesce(a.j, d.j) as j, x, y, a.i as ai, d.i as di, a.j as aj, d.j as dj from a full join d on a."array" = d."array" and a.i = d.i and a.j = d.j),
f as (select *, case when x is not distinct from y then 0 when x is null or y is null then 'infinity'::double else abs(x - y) end as diff from b),
g as (select "array", count(*) as cells, sum((ai is null or di is null)::int)::bigint as one_sided, max(diff) as max_abs, max(case when diff = 'infinity'::double then diff else diff / greatest(abs(y), 2.220446049250313e-16) end) as max_rel,
 arg_max(i || ',' || j, (diff, -i, -j)) as worst_at, bool_and(ai is not null and di is not null and coalesce(diff <= 0.1 * abs(x), false)) as good, max(ai) = max(di) and max(aj) = max(dj) as same from f group by 1)
select "array", case when not same then 'shape_mismatch' when good then 'passed' else 'failed' end as status, cells, one_sided, case when same and max_abs < 'infinity'::double then round(max_abs, 6) end as max_abs, case when same and max_rel < 'infinity'::double then round(max_rel, 6) end as max_rel,
 case when same then worst_at end as worst_at, same and good as passed from g"""
)
def array_compare(spark, sf_dir):
    """Arrays of line items: one with holes, one of other shapes, and two whose verdict hangs on which side's value scales the tolerance."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("array"), F.col("l_orderkey").alias("i"), F.col("l_linenumber").cast("long").alias("j"), F.col("l_quantity").cast("double").alias("v"), F.col("l_tax").cast("double").alias("tax"))
    a = rows.where("not (array = 'AF' and j = 3)").select("array", "i", "j", F.col("v").alias("value"))
    moved = F.expr("v * case when i % 100 = 1 then 1 + tax when i % 100 = 2 and array = 'RF' then 1.105D when i % 100 = 2 then 0.905D else 1 end")
    d = rows.where("not (array = 'AF' and j = 4) and not (array = 'NF' and j = 7)").select("array", "i", "j", moved.alias("value"))
    out = compare.compare_arrays(a, d, ["i", "j"], 0.1, 0)
    return out.withColumns({c: F.when(F.col(c) < F.lit(float("inf")), F.round(c, 6)) for c in ("max_abs", "max_rel")})


@query(
    """with a as (select distinct p_brand as array from part where p_size < 25), d as (select distinct p_brand as array from part where p_retailprice > 1000)
select coalesce(a.array, d.array) as array, case when a.array is null then 'missing' when d.array is null then 'extra' else 'both' end as status from a full join d on a.array = d.array"""
)
def dir_compare(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("array", F.col("p_brand"))
    return compare.compare_names(p.where("p_size < 25"), p.where("p_retailprice > 1000"))


BENCH = "select s_nationkey as kernel, s_name as machine, round(abs(s_acctbal), 2) as elapsed, s_acctbal > 0 as available, s_suppkey % 7 = 0 as skipped from supplier"


@query(
    f"""with r as ({BENCH}), u as (select * from r where available and not skipped and elapsed > 0)
select kernel, machine, elapsed, first_value(elapsed) over (partition by kernel order by elapsed, machine) as baseline, round(first_value(elapsed) over (partition by kernel order by elapsed, machine) / elapsed, 6) as speedup from u"""
)
def bench_speedup(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("kernel"), F.col("s_name").alias("machine"), F.round(F.abs("s_acctbal"), 2).alias("elapsed"), F.expr("s_acctbal > 0").alias("available"), F.expr("s_suppkey % 7 = 0").alias("skipped"))
    return compare.speedups(r, ["kernel"]).select("kernel", "machine", "elapsed", "baseline", F.round("speedup", 6).alias("speedup"))


@query(
    """with r as (select s_suppkey as id, s_nationkey % 5 as kernel, s_nationkey as horizon, abs(s_acctbal) + 1 as elapsed from supplier),
b as (select n_nationkey as ord, n_regionkey as kernel, case when n_nationkey % 3 = 0 then null else n_nationkey end as horizon, n_nationkey * 10.0::double as elapsed from nation),
m as (select r.*, b.elapsed as baseline, row_number() over (partition by r.id order by b.ord) as nth from r left join b on r.kernel = b.kernel and (b.horizon is null or b.horizon = r.horizon))
select id, kernel, horizon, round(elapsed, 4) as elapsed, baseline, case when baseline > 0 then round(baseline / elapsed, 6) end as speedup from m where nth = 1"""
)
def baseline_match(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("s_nationkey % 5").alias("kernel"), F.col("s_nationkey").alias("horizon"), (F.abs("s_acctbal") + 1).alias("elapsed"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_regionkey").alias("kernel"), F.expr("case when n_nationkey % 3 <> 0 then n_nationkey end").alias("horizon"), (F.col("n_nationkey") * 10.0).alias("elapsed"))
    out = compare.matched_baseline(r, b, ["kernel"], ["horizon"])
    return out.withColumns({"elapsed": F.round("elapsed", 4), "speedup": F.round("speedup", 6)})


@query("select event_type, count(*) as n, count(try_cast(json_extract_string(props, '$.k') as double)) as parsed, round(avg(try_cast(json_extract_string(props, '$.k') as double)), 6) as mean_k from events group by 1")
def json_payload_parse(spark, sf_dir):
    k = vintages.parsed_number(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").withColumn("k", k).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("parsed"), F.round(F.avg("k"), 6).alias("mean_k"))


@query(
    """with i as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d, strftime(o_orderdate, '%Y%m%d') as stamp, o_totalprice from orders)
select d as obs_date, round(o_totalprice, 2)::decimal(18,2)::double as value, strftime(strptime(stamp, '%Y%m%d'), '%Y-%m-%d') as realtime_start, strftime(strptime(stamp, '%Y%m%d'), '%Y-%m-%d') as realtime_end from i"""
)
def json_vintage_parse(spark, sf_dir):
    """Orders written as wide-vintage payloads (two vintages a row, the older one stale) and read back."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    item = F.create_map(F.lit("date"), day, F.concat(F.lit("GDP_"), F.date_format("o_orderdate", "yyyyMMdd")), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("GDP_19000101"), F.lit("1.0"))
    payload = F.to_json(F.struct(F.array(item).alias("observations")))
    return vintages.parse_observations(table(spark, sf_dir, "orders").select(payload.alias("payload")), "payload", "GDP").select(*[F.col(c).cast("string").alias(c) for c in ("obs_date", "realtime_start", "realtime_end")], F.round("value", 2).alias("value"))


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, count(*) as lines, sum(case when contains(lower(line), 'license') then 1 else 0 end)::bigint as hits from l group by doc_id"""
)
def text_purity_scan(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    hits = F.size(F.filter(lines, lambda x: F.lower(x).contains("license")))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(lines).cast("long").alias("lines"), hits.cast("long").alias("hits"))


@query(
    """select p_partkey, try_cast(nullif(regexp_extract(p_brand, '([0-9.]+)', 1), '') as double) as number, replace(p_type, ' ', '_') as label, starts_with(p_name, 'p') as prefixed
from part where p_size in (1, 5, 9) and p_brand not in ('Brand#11', 'Brand#22')"""
)
def regex_label_parse(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.col("p_size").isin(1, 5, 9) & ~F.col("p_brand").isin("Brand#11", "Brand#22"))
    return p.select("p_partkey", F.regexp_extract("p_brand", "([0-9.]+)", 1).try_cast("double").alias("number"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("label"), F.startswith("p_name", F.lit("p")).alias("prefixed"))


@query("select vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: embedding[i]::double * (i % 5 - 2))) + 0.5, 6) as value from embeddings")
def linear_measurement(spark, sf_dir):
    """Z s + d for one row of Z, as an expression over the state array."""
    z = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 5 - 2).cast("double"))
    s = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(F.zip_with(s, z, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + 0.5, 6).alias("value"))
