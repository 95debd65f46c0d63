"""Levels to observables, population helpers and requirements, with quarterly aggregates standing in for the levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transforms as T
from ..functions.quarters import quarter_index
from ..operators import ingest, observables
from ..operators.observables import Observable
from ..sources import levels as L
from .registry import query, table

LEVELS = """with o as (select (year(o_orderdate) * 4 + quarter(o_orderdate))::int as quarter_idx, sum(o_totalprice::decimal(18,2))::double as s, count(*)::double as n, count(distinct o_custkey)::double as m from orders group by 1),
l as (select (year(l_shipdate) * 4 + quarter(l_shipdate))::int as quarter_idx, sum(l_extendedprice::decimal(18,2))::double as ls, sum(l_quantity::decimal(18,2))::double as lq,
 sum(l_tax::decimal(18,2))::double / count(*) as lt, sum(l_discount::decimal(18,2))::double / count(*) as ld from lineitem group by 1),
v as (select quarter_idx, s / 1e6 as GDP, n as CNP16OV, ls / lq / 1000 as GDPDEF, 30 + ld * 100 as AWHNONAG, m as CE16OV, s / n as COMPNFB, ls / 1e6 as PCEPILFE, ld * 100 as DFF, s / 2e6 as PCE, ls / 4e6 as FPI, 5 + lt * 100 as BAA,
 case when quarter_idx % 2 = 1 then 6 + ld * 10 end as BAMLC8A0C15PYEY, lt * 100 as GS10, s / 1.1e6 as GDI, ld * 50 as ASACX10, lt * 80 as FYCCZA, ld * 10 as TFPKQ, 0.3 + lt as TFPJQ from o join l using (quarter_idx))"""


def levels(spark, sf_dir):
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    o = table(spark, sf_dir, "orders").groupBy(quarter_index("o_orderdate").alias("quarter_idx")).agg(exact("o_totalprice").alias("s"), F.count(F.lit(1)).cast("double").alias("n"), F.countDistinct("o_custkey").cast("double").alias("m"))
    l = table(spark, sf_dir, "lineitem").groupBy(quarter_index("l_shipdate").alias("quarter_idx")).agg(exact("l_extendedprice").alias("ls"), exact("l_quantity").alias("lq"), ingest.exact_mean("l_tax").alias("lt"), ingest.exact_mean("l_discount").alias("ld"))  # noqa: E741
    columns = {
        "GDP": "s / 1e6D", "CNP16OV": "n", "GDPDEF": "ls / lq / 1000", "AWHNONAG": "30 + ld * 100", "CE16OV": "m", "COMPNFB": "s / n", "PCEPILFE": "ls / 1e6D", "DFF": "ld * 100", "PCE": "s / 2e6D", "FPI": "ls / 4e6D", "BAA": "5 + lt * 100",
        "BAMLC8A0C15PYEY": "case when quarter_idx % 2 = 1 then 6 + ld * 10 end", "GS10": "lt * 100", "GDI": "s / 1.1e6D", "ASACX10": "ld * 50", "FYCCZA": "lt * 80", "TFPKQ": "ld * 10", "TFPJQ": "0.3D + lt",
    }
    return o.join(l, "quarter_idx").select("quarter_idx", *[F.expr(e).alias(c) for c, e in columns.items()])


OBSERVABLES = [
    Observable("obs_gdp", "gdp_growth"), Observable("obs_hours", "hours_per_capita"), Observable("obs_wages", "real_wage_growth"), Observable("obs_gdpdeflator", "gdp_deflator_growth"), Observable("obs_corepce", "core_pce_growth"),
    Observable("obs_nominalrate", "nominal_rate"), Observable("obs_consumption", "consumption_growth"), Observable("obs_investment", "investment_growth"), Observable("obs_spread", "baa_10y_spread"), Observable("obs_longinflation", "long_inflation_expectations"),
    Observable("obs_longrate", "long_rate"), Observable("obs_tfp", "fernald_tfp"), Observable("obs_gdi", "gdi_growth"), Observable("obs_nominalrate1", "anticipated_rate", ("DFF__OIS",)),
]
_W = "(order by quarter_idx)"
_G = lambda x: f"100 * (ln({x}) - lag(ln({x})) over {_W})"
_R = lambda c, k: _G(f"({k} * {c} / CNP16OV / GDPDEF * 100)")
FORMULAS = {
    "obs_gdp": _R("GDP", 1000), "obs_hours": "100 * ln(3 * AWHNONAG * CE16OV / CNP16OV / 100)", "obs_wages": _G("(COMPNFB / GDPDEF * 100)"), "obs_gdpdeflator": _G("GDPDEF"), "obs_corepce": _G("PCEPILFE"), "obs_nominalrate": "DFF / 4",
    "obs_consumption": _R("PCE", 1000), "obs_investment": _R("FPI", 10000), "obs_spread": "(case when quarter_idx >= 8068 and BAMLC8A0C15PYEY is not null then BAMLC8A0C15PYEY else BAA end - GS10) / 4", "obs_longinflation": "(ASACX10 - 0.5) / 4",
    "obs_longrate": "FYCCZA / 4", "obs_tfp": "(TFPKQ - avg(TFPKQ) over ()) / (4 * (1 - TFPJQ))", "obs_gdi": _R("GDI", 1000), "obs_nominalrate1": "DFF",
}


@query(f"{LEVELS} select quarter_idx, " + ", ".join(f"round({e}, 6) + 0.0::double as {n}" for n, e in FORMULAS.items()) + " from v")
def forward_transforms(spark, sf_dir):
    out = observables.observed(levels(spark, sf_dir), OBSERVABLES)
    return out.select("quarter_idx", *[(F.round(o.name, 6) + F.lit(0.0)).alias(o.name) for o in OBSERVABLES])


@query(f"{LEVELS}, t as (select quarter_idx, {FORMULAS['obs_gdp']} as g, DFF / 4 as r from v) select quarter_idx, round(g, 6) + 0.0::double as first, round(r, 6) as second, 2::bigint as width from t where quarter_idx >= 7984 and quarter_idx < 8000")
def observable_matrix(spark, sf_dir):
    """Transforms first, then the sample: the first row of the sample has a growth rate."""
    o = observables.observed(levels(spark, sf_dir), OBSERVABLES)
    m = observables.ordered_matrix(o, ["obs_gdp", "obs_nominalrate"], 7984, 8000)
    return m.select("quarter_idx", (F.round(F.col("y")[0], 6) + F.lit(0.0)).alias("first"), F.round(F.col("y")[1], 6).alias("second"), F.size("y").cast("long").alias("width"))


@query(f"{LEVELS}, r as (select quarter_idx, CNP16OV from v where quarter_idx < 7990), f as (select quarter_idx, CNP16OV * 2 as p from v) select quarter_idx, p from f where quarter_idx >= (select max(quarter_idx) from r)")
def population_tail(spark, sf_dir):
    v = levels(spark, sf_dir)
    return observables.forecast_tail(v.where("quarter_idx < 7990"), v.select("quarter_idx", (F.col("CNP16OV") * 2).alias("p")))


@query()
def population_trend(spark, sf_dir):
    """Recorded and filtered population with their growth; tests hold the trend against a dense solve over the recorded quarters and the tail."""
    v = levels(spark, sf_dir)
    return observables.population_helpers(v.where("quarter_idx < 7990").select("quarter_idx", "CNP16OV"), "CNP16OV", v.select("quarter_idx", "CNP16OV"))


NAMES = "select n_name || case n_nationkey % 3 when 0 then '' when 1 then '__bea' else '__DLX' end as name, n_nationkey as ord from nation union all select 'NATION_0__fred', 99"


@query(
    f"""with n as ({NAMES}), p as (select upper(case when contains(name, '__') then split_part(name, '__', 2) else 'FRED' end) as source, upper(split_part(name, '__', 1)) as mnemonic, ord from n),
d as (select source, mnemonic, min(ord) as ord from p group by all)
select source, string_agg(mnemonic, ',' order by ord) as mnemonics, min(ord)::bigint as ord, coalesce(string_agg(mnemonic, ',' order by ord) filter (where mnemonic in ('NATION_3', 'NATION_7')), '') as optional from d group by source"""
)
def source_requirements(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.expr("n_name || case n_nationkey % 3 when 0 then '' when 1 then '__bea' else '__DLX' end").alias("name"), F.col("n_nationkey").cast("long").alias("ord"))
    rows = n.unionByName(spark.range(1).select(F.lit("NATION_0__fred").alias("name"), F.lit(99).cast("long").alias("ord")))
    return L.requirements(rows, ["NATION_3", "NATION_7"]).select("source", F.array_join("mnemonics", ",").alias("mnemonics"), "ord", F.array_join("optional", ",").alias("optional"))


@query(
    f"""{LEVELS}, s as (select quarter_idx, GDP, BAMLC8A0C15PYEY as B from v union all select quarter_idx, GDP, null from v where quarter_idx = 7990),
g as (select i::int as quarter_idx from generate_series(7984, 8008) as t(i)), lab as (select *, ((quarter_idx - 1) // 4)::varchar || '-Q' || ((quarter_idx - 1) % 4 + 1)::varchar as what from g)
select 'FRED' as source, 'repeated quarter' as fault, '1997-Q2' as what where (select count(*) from s where quarter_idx = 7990) > 1
union all select 'FRED', 'missing quarter', what from lab where quarter_idx not in (select quarter_idx from s)
union all select 'FRED', 'missing column', 'ABSENT'
union all select 'FRED', 'missing value', 'B ' || what from lab where quarter_idx in (select quarter_idx from s) and quarter_idx not in (select quarter_idx from s where B is not null)"""
)
def source_faults(spark, sf_dir):
    v = levels(spark, sf_dir).select("quarter_idx", "GDP", F.col("BAMLC8A0C15PYEY").alias("B"))
    twice = v.unionByName(v.where("quarter_idx = 7990").withColumn("B", F.lit(None).cast("double")))
    return L.faults(twice, "FRED", ["GDP", "B", "ABSENT", "OPTIONAL"], ["OPTIONAL"], 7984, 8008)


@query(f"{LEVELS} select quarter_idx, round(GDP, 6) as GDP, round(DFF, 6) as DFF, null::double as OPTIONAL from v where quarter_idx between 7984 and 7999")
def levels_from_sources(spark, sf_dir):
    v = levels(spark, sf_dir)
    sources = {"FRED": (v.select("quarter_idx", "GDP"), ["GDP", "OPTIONAL"]), "DLX": (v.select("quarter_idx", "DFF"), ["DFF"])}
    out = L.levels_from_sources(sources, ["OPTIONAL"], (7984, 7999))
    return out.select("quarter_idx", F.round("GDP", 6).alias("GDP"), F.round("DFF", 6).alias("DFF"), "OPTIONAL")


@query(
    """with r as (select n_regionkey as region, list(n_nationkey % 7 + 1) as hs from nation group by 1)
select region, array_to_string(list_sort(list_distinct(case when region % 2 = 0 then hs else [3, 1, 2] end)), ',') as horizons from r"""
)
def expected_rate_horizons(spark, sf_dir):
    r = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.collect_list(F.expr("cast(n_nationkey % 7 + 1 as int)")).alias("hs"))
    regimes = F.when(F.col("region") % 2 == 0, F.create_map(F.lit("a"), "hs", F.lit("b"), "hs"))
    return r.select("region", F.array_join(T.horizons(regimes, F.array(F.lit(3), F.lit(1), F.lit(2))), ",").alias("horizons"))
