"""State-space, estimation and solver queries: kernels in grouped operators, scalar ones with recursive oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import transforms as T
from ..functions.quarters import quarter_index
from ..plans import statespace
from ..plans.equations import Model, solutions
from ..plans.forecasting import responses_many
from ..plans.likelihood import Systems
from .registry import query, table

Q = "(year(o_orderdate) * 4 + quarter(o_orderdate))::int"
BASE = f"""q as (select o_orderpriority as series, {Q} as quarter_idx, avg(o_totalprice) / 100000 as v from orders group by all),
y as (select series, quarter_idx, case when quarter_idx % 7 <> 0 then v end as y, row_number() over (partition by series order by quarter_idx) as t from q)"""

#: Local level: state variance 0.01, noise 0.04; known start.
LEVEL = statespace.System.of(1.0, 1.0, 0.01, 1.0, 0.04)
AR = statespace.System.of(0.8, 1.0, 0.25, 1.0)
#: Two states, two observables, two shocks.
PAIR = statespace.System.of([[0.7, 0.1], [0.0, 0.5]], np.eye(2), np.diag([0.04, 0.09]), [[1.0, 0.0], [0.5, 1.0]], np.diag([0.01, 0.02]))


def observed(spark, sf_dir):
    """Quarterly means per priority; every seventh quarter's is missing."""
    q = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), quarter_index("o_orderdate").alias("quarter_idx")).agg((F.avg("o_totalprice") / 100000).alias("v"))
    return q.select("series", "quarter_idx", F.when(F.col("quarter_idx") % 7 != 0, F.col("v")).alias("y"))


FILTER = f"""with recursive {BASE},
f(series, t, s, p, pred, pred_p, ll) as (
  select series, 0::bigint, 0::double, 1e6::double, 0::double, 0::double, 0::double from (select distinct series from y)
  union all
  select f.series, y.t, case when y.y is null then f.s else f.s + (f.p + 0.01) / (f.p + 0.05) * (y.y - f.s) end,
   case when y.y is null then f.p + 0.01 else (f.p + 0.01) - (f.p + 0.01) * (f.p + 0.01) / (f.p + 0.05) end, f.s, f.p + 0.01,
   case when y.y is null then 0 else -0.5 * (ln(2 * pi()) + ln(f.p + 0.05) + (y.y - f.s) * (y.y - f.s) / (f.p + 0.05)) end
  from f join y on y.series = f.series and y.t = f.t + 1)"""


@query(f"{FILTER} select series, (t - 1)::int as t, round(ll, 5) as loglik, round(s, 5) as state, round(p, 4) as variance from f where t > 0")
def local_level_filter(spark, sf_dir):
    out = statespace.filter_groups(observed(spark, sf_dir), "series", "quarter_idx", ["y"], LEVEL)
    return out.select("series", "t", F.round("loglik", 5).alias("loglik"), F.round(F.col("state")[0], 5).alias("state"), F.round(F.col("cov")[0], 4).alias("variance"))


@query(
    FILTER
    + """, n as (select series, max(t) as n from f group by 1),
b(series, t, s) as (select f.series, f.t, f.s from f join n on f.series = n.series and f.t = n.n
  union all select b.series, f.t, f.s + f.p / nx.pred_p * (b.s - nx.pred) from b join f on f.series = b.series and f.t = b.t - 1 join f nx on nx.series = b.series and nx.t = b.t where f.t >= 1)
select series, (t - 1)::int as t, round(s, 5) as state from b"""
)
def local_level_smoother(spark, sf_dir):
    out = statespace.filter_groups(observed(spark, sf_dir), "series", "quarter_idx", ["y"], LEVEL, smooth=True)
    return out.select("series", "t", F.round(F.col("smooth_state")[0], 5).alias("state"))


@query("with n as (select n_nationkey, n_nationkey / 10.0::double as s0 from nation) select n_nationkey, h::int as h, round(s0 * 0.8 ** (h + 1), 6) as value from n, generate_series(0, 11) as g(h)")
def ar1_forecast(spark, sf_dir):
    """Point forecasts from many starting states, as one batched recursion per Arrow batch."""

    def kernel(parts):
        for pdf in parts:
            y = statespace.simulated(AR, pdf["s0"].to_numpy(float)[:, None], np.zeros((len(pdf), 12, 1)))[..., 0]
            n, h = np.meshgrid(pdf["n_nationkey"], np.arange(12), indexing="ij")
            yield type(pdf)({"n_nationkey": n.ravel(), "h": h.ravel(), "value": y.ravel()})

    starts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), (F.col("n_nationkey") / 10.0).alias("s0"))
    return starts.mapInPandas(kernel, "n_nationkey int, h int, value double").withColumn("value", F.round("value", 6))


@query("select p_partkey, h::int as h, 0 as variable, 0 as shock, round(0.5 * (p_size / 61.7::double) ** h, 6) as response from part, generate_series(0, 11) as g(h)")
def ar1_irf(spark, sf_dir):
    """Responses to one deviation of the shock, a system a part, all of a batch at once."""

    def kernel(batches):
        for pdf in batches:
            one = np.ones((len(pdf), 1, 1))
            systems = Systems(pdf["rho"].to_numpy(float)[:, None, None], one, one[:, 0] * 0, one * 0.25, one, one[:, 0] * 0, one * 0)
            r = responses_many(systems, 12)
            row, h, v, k = (x.ravel() for x in np.indices(r.shape))
            yield type(pdf)({"p_partkey": pdf["p_partkey"].to_numpy()[row], "h": h, "variable": v, "shock": k, "response": r.ravel()})

    systems = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 61.7).alias("rho"))
    kind = systems.schema["p_partkey"].dataType.simpleString()
    return systems.mapInPandas(kernel, f"p_partkey {kind}, h int, variable int, shock int, response double").withColumn("response", F.round("response", 6))


def pairs(spark, sf_dir):
    y = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series"), quarter_index("l_shipdate").alias("quarter_idx"))
    y = y.agg((F.avg("l_discount") * 10).alias("a"), (F.avg("l_tax") * 10).alias("b"))
    return y.select("series", "quarter_idx", F.when(F.col("quarter_idx") % 5 != 0, F.col("a")).alias("a"), "b")


PAIR_SQL = """with recursive q as (select l_returnflag as series, (year(l_shipdate) * 4 + quarter(l_shipdate))::int as quarter_idx, avg(l_discount) * 10 as a, avg(l_tax) * 10 as b from lineitem group by all),
y as (select series, case when quarter_idx % 5 <> 0 then a end as a, b, row_number() over (partition by series order by quarter_idx) as t from q),
f(series, t, s1, s2, p11, p12, p22, r1, r2, v11, v12, v22, ll) as (
  select series, 0::bigint, 0::double, 0::double, (0.14 * (0.05 * 0.12 / 0.65) + 0.01 * 0.12 + 0.04) / 0.51, 0.05 * 0.12 / 0.65, 0.12::double, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double from (select distinct series from y)
  union all
  select series, t, r1 + g1a * ea + g1b * eb, r2 + g2a * ea + g2b * eb,
    v11 - g1a * v11 - g1b * (0.5 * v11 + v12), v12 - g1a * v12 - g1b * (0.5 * v12 + v22), v22 - g2a * v12 - g2b * (0.5 * v12 + v22), r1, r2, v11, v12, v22, ll
  from (select *, case when a is null then 0 else (v11 * fbb - zb1 * fab) / det end as g1a, case when a is null then zb1 / fbb else (zb1 * faa - v11 * fab) / det end as g1b,
      case when a is null then 0 else (v12 * fbb - zb2 * fab) / det end as g2a, case when a is null then zb2 / fbb else (zb2 * faa - v12 * fab) / det end as g2b,
      case when a is null then -0.5 * (ln(2 * pi()) + ln(fbb) + eb * eb / fbb) else -0.5 * (2 * ln(2 * pi()) + ln(det) + (ea * ea * fbb - 2 * ea * eb * fab + eb * eb * faa) / det) end as ll
    from (select *, faa * fbb - fab * fab as det from (select *, v11 + 0.01 as faa, zb1 as fab, 0.5 * zb1 + zb2 + 0.02 as fbb, coalesce(a - r1, 0) as ea, b - 0.5 * r1 - r2 as eb from (select *, 0.5 * v11 + v12 as zb1, 0.5 * v12 + v22 as zb2 from (
      select y.series, y.t, y.a, y.b, 0.7 * s1 + 0.1 * s2 as r1, 0.5 * s2 as r2, 0.49 * p11 + 0.14 * p12 + 0.01 * p22 + 0.04 as v11, 0.35 * p12 + 0.05 * p22 as v12, 0.25 * p22 + 0.09 as v22 from f join y on y.series = f.series and y.t = f.t + 1))))) as x),
b(series, t, s1, s2) as (
  select f.series, f.t, f.s1, f.s2 from f join (select series, max(t) as t from f group by 1) n using (series, t)
  union all
  select b.series, f.t, f.s1 + (j11 * i11 + j12 * i12) * d1 + (j11 * i12 + j12 * i22) * d2, f.s2 + (j21 * i11 + j22 * i12) * d1 + (j21 * i12 + j22 * i22) * d2
  from b join (select f.*, 0.7 * f.p11 + 0.1 * f.p12 as j11, 0.5 * f.p12 as j12, 0.7 * f.p12 + 0.1 * f.p22 as j21, 0.5 * f.p22 as j22, n.r1 as n1, n.r2 as n2,
      n.v22 / (n.v11 * n.v22 - n.v12 * n.v12) as i11, -n.v12 / (n.v11 * n.v22 - n.v12 * n.v12) as i12, n.v11 / (n.v11 * n.v22 - n.v12 * n.v12) as i22 from f join f n on n.series = f.series and n.t = f.t + 1 where f.t > 0) f
    on f.series = b.series and f.t = b.t - 1, lateral (select b.s1 - f.n1 as d1, b.s2 - f.n2 as d2))"""


@query(PAIR_SQL + """ select f.series, (f.t - 1)::int as t, round(ll, 5) as loglik, round(f.s1, 5) as s1, round(f.s2, 5) as s2, round(p11, 5) as p11, round(p12, 5) as p12, round(p22, 5) as p22, round(b.s1, 5) as smooth1, round(b.s2, 5) as smooth2 from f join b using (series, t)""")
def kalman_multivariate(spark, sf_dir):
    """Two observables with gaps, every group filtered and smoothed in one pass."""
    out = statespace.filter_groups(pairs(spark, sf_dir), "series", "quarter_idx", ["a", "b"], PAIR, smooth=True)
    cells = {"s1": ("state", 0), "s2": ("state", 1), "p11": ("cov", 0), "p12": ("cov", 1), "p22": ("cov", 3), "smooth1": ("smooth_state", 0), "smooth2": ("smooth_state", 1)}
    return out.select("series", "t", F.round("loglik", 5).alias("loglik"), *[F.round(F.col(c)[k], 5).alias(n) for n, (c, k) in cells.items()])


@query(
    PAIR_SQL
    + """, e as (select b.series, b.t, b.s1 - 0.7 * l.s1 - 0.1 * l.s2 as e1, b.s2 - 0.5 * l.s2 as e2 from b join b l on l.series = b.series and l.t = b.t - 1),
c(series, t, b1, b2, x1, x2, z1, z2) as (
  select series, t, s1, s2, 0::double, 0::double, 0::double, 0::double from b where t = 1
  union all select c.series, e.t, 0.7 * b1 + 0.1 * b2, 0.5 * b2, 0.7 * x1 + 0.1 * x2 + e1, 0.5 * x2, 0.7 * z1 + 0.1 * z2, 0.5 * z2 + e2 from c join e on e.series = c.series and e.t = c.t + 1),
o as (select *, unnest([0, 1]) as variable from c join y using (series, t)),
p as (select series, t, variable, unnest([-1, 0, 1]) as driver, unnest(case variable when 0 then [b1, x1, z1] else [0.5 * b1 + b2, 0.5 * x1 + x2, 0.5 * z1 + z2] end) as value, case variable when 0 then a else b end as y from o),
r as (select series, t, variable, 2 as driver, any_value(y) - sum(value) as value from p group by series, t, variable)
select series, (t - 1)::int as t, variable, driver, round(value, 5) + 0.0 as value from (select series, t, variable, driver, value from p union all select * from r)"""
)
def historical_decomposition(spark, sf_dir):
    out = statespace.decompose_groups(pairs(spark, sf_dir), "series", "quarter_idx", ["a", "b"], PAIR)
    return out.withColumn("value", F.round("value", 5) + F.lit(0.0))


def _conditioning_sql(first: int = 2, last: int = 5) -> str:
    """Smallest shocks e = A' x with (A A') x = target: A A' is factored cell by cell, once, as every nation asks for one height."""
    h = range(first, last + 1)
    answer = lambda j, s: f"0.7 ** ({j})" if s == 0 else f"0.5 * (0.7 ** ({j}) - 0.5 ** ({j}))"  # noqa: E731  of the first state, j quarters after shock s
    gram = [f"(select sum({' + '.join(f'({answer(f"{a} - k", s)}) * ({answer(f"{b} - k", s)})' for s in (0, 1))}) from generate_series(0, {b}) as t(k)) as g{a}{b}" for a in h for b in h if b <= a]
    steps = []
    for b in h:
        steps.append(f"sqrt(g{b}{b}{''.join(f' - l{b}{c} ** 2' for c in h if c < b)}) as l{b}{b}")
        steps += [f"(g{a}{b}{''.join(f' - l{a}{c} * l{b}{c}' for c in h if c < b)}) / l{b}{b} as l{a}{b}" for a in h if a > b]
    steps += [f"(1{''.join(f' - l{a}{c} * y{c}' for c in h if c < a)}) / l{a}{a} as y{a}" for a in h]
    steps += [f"(y{a}{''.join(f' - l{c}{a} * x{c}' for c in h if c > a)}) / l{a}{a} as x{a}" for a in reversed(h)]
    sums = " + ".join(f"case when t.h <= {a} then x{a} * case s.k when 0 then {answer(f'{a} - t.h', 0)} else {answer(f'{a} - t.h', 1)} end else 0 end" for a in h)
    return f"""with g as (select {", ".join(gram)}), f as (select {", ".join(steps)} from g)
select n_nationkey as scenario, t.h::int as h, s.k::int as shock, round(n_nationkey / 10.0::double * ({sums}), 6) + 0.0 as value from nation, f, generate_series(0, {last}) as t(h), generate_series(0, 1) as s(k)"""


@query(_conditioning_sql())
def conditioning_lstsq(spark, sf_dir):
    """Smallest shocks that put each nation's path on its target, one group a nation."""
    t = table(spark, sf_dir, "nation").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(5))))
    t = t.select(F.col("n_nationkey").alias("scenario"), "h", F.lit(0).alias("variable"), F.when(F.col("h") >= 2, F.col("n_nationkey") / 10.0).alias("value"))
    out = statespace.condition_groups(t, "scenario", PAIR, np.zeros(2))
    return out.withColumn("value", F.round("value", 6) + F.lit(0.0))


#: Cells of a forward-looking pair: states x, E x(+1), z.
FORWARD = (("g0", 0, 0, "1"), ("g0", 0, 1, "-0.9"), ("g0", 0, 2, "-1"), ("g0", 1, 0, "1"), ("g0", 2, 2, "1"), ("g1", 1, 1, "1"), ("g1", 2, 2, "rho"), ("psi", 2, 0, "1"), ("pi", 1, 0, "1"))


@query("select p_partkey, round(p_size / 60.0::double, 6) as t, round(1 / (1 - 0.9 * p_size / 60.0::double), 6) as r from part")
def forward_looking_solve(spark, sf_dir):
    """x = 0.9 E[x(+1)] + z, z = rho z(-1) + e, a system a part: x responds 1 / (1 - 0.9 rho) to e."""
    model = Model({"states": 3, "shocks": 1, "errors": 1}, FORWARD, ("rho",))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 60.0).alias("rho"))
    out = solutions(rows, ["p_partkey"], model).where("exists = 1 and unique = 1")
    return out.select("p_partkey", F.round(F.element_at("t", 9), 6).alias("t"), F.round(F.element_at("r", 1), 6).alias("r"))


@query("select p_partkey, round(0.5 * 2.0 * (p_size - 25) / 10.0, 6) as z, round(exp(-0.5 * ((p_size - 25) / 10.0) ** 2) / sqrt(2 * pi()), 6) as density from part")
def standard_normal(spark, sf_dir):
    z = (F.col("p_size") - 25) / 10.0
    return table(spark, sf_dir, "part").select("p_partkey", F.round(z, 6).alias("z"), F.round(F.exp(-0.5 * z * z) / T.c(F.sqrt(F.lit(2 * np.pi))), 6).alias("density"))


@query(FILTER + ", n as (select series, max(t) as n from f group by 1) select f.series, h::int as h, 0 as variable, round(f.s, 5) as value from f join n on f.series = n.series and f.t = n.n, generate_series(0, 5) as g(h)")
def history_forecast(spark, sf_dir):
    """Every series forecast from its last filtered state (a level stays where it is)."""
    out = statespace.forecast_groups(observed(spark, sf_dir), "series", "quarter_idx", ["y"], LEVEL, 6)
    return out.withColumn("value", F.round("value", 5))


def _scenario_sql() -> str:
    from .paths import PATH

    return f"""{PATH}, z as (select scenario, h, sum(value) as e from p group by all), g as (select distinct scenario, x::int as h from c, generate_series(0, 5) as t(x))
select g.scenario, g.h, 0 as variable, round(0.8 ** (g.h + 1), 6) as baseline, round(coalesce(sum(z.e * 0.8 ** (g.h - z.h)), 0), 6) + 0.0::double as deviation from g left join z on z.scenario = g.scenario and z.h <= g.h group by all"""


@query(_scenario_sql())
def scenario_paths(spark, sf_dir):
    """Structural scenarios run through an autoregression, beside their baseline."""
    from ..operators import scenarios
    from .paths import components

    shocks = scenarios.structural_path(components(spark, sf_dir), 6).withColumn("shock", F.lit("e"))
    out = statespace.scenario_paths(shocks, "scenario", ["e"], AR, np.array([1.0]), 6)
    return out.select("scenario", "h", "variable", F.round("baseline", 6).alias("baseline"), (F.round("deviation", 6) + F.lit(0.0)).alias("deviation"))
