"""From levels to the series a model observes: named transforms, population helpers, the ordered matrix."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import transforms as T
from ..plans.smoothing import trends
from .ingest import CoverageError, sample

#: The first quarter from which the replacement of the corporate yield counts, and the filtered population's name.
SPLICE, FILTERED = 2016 * 4 + 4, "filtered_population_recorded"


@dataclass(frozen=True)
class Observable:
    name: str
    transform: str
    sources: tuple[str, ...] = ()


def resolved(columns: Sequence[str], name: str) -> str:
    """The column of a name `MNEMONIC__SOURCE`: that name, else its mnemonic."""
    for candidate in (name, name.split("__")[0]):
        if candidate in columns:
            return candidate
    raise CoverageError(f"missing column: {name}")


@dataclass
class Levels:
    """Columns of a table of levels, one row a quarter (and key)."""

    columns: Sequence[str]
    keys: Sequence[str] = ()
    order: str = "quarter_idx"
    population: str = "CNP16OV__FRED"
    settings: dict = field(default_factory=dict)

    def __call__(self, name: str) -> Column:
        return F.col(resolved(self.columns, name))

    def has(self, name: str) -> bool:
        return name in self.columns or name.split("__")[0] in self.columns

    def heads(self) -> Column:
        filtered = FILTERED in self.columns and self.settings.get("hpfilter_population", True)
        return F.col(FILTERED) if filtered else self(self.population)

    def growth(self, x: Column) -> Column:
        return T.log_growth(x, self.keys, self.order)

    def real_growth(self, name: str, scale: float) -> Column:
        return T.real_growth_per_capita(self(name), self.heads(), self("GDPDEF"), self.keys, self.order, scale)

    def spread(self) -> Column:
        yields = self("BAA")
        if self.has("BAMLC8A0C15PYEY"):
            yields = T.spliced(yields, self("BAMLC8A0C15PYEY"), self.order, SPLICE)
        return (yields - self("GS10")) / 4

    def long_inflation(self) -> Column:
        ten_year = self.settings.get("subspec") == "ss102" and self.has("PCE10")
        return self("PCE10") / 4 if ten_year else T.expected_inflation(self("ASACX10"))


def first_source(levels: Levels, o: Observable) -> Column:
    return levels(o.sources[0])


#: The names of forward transforms and the mnemonics and scales that each takes.
FORWARD: dict[str, Callable[[Levels, Observable], Column]] = {
    "identity": first_source,
    "gdp_growth": lambda x, o: x.real_growth("GDP", 1000),
    "hours_per_capita": lambda x, o: T.hours_worked(x("AWHNONAG"), x("CE16OV"), x.heads()),
    "real_wage_growth": lambda x, o: x.growth(T.real(x("COMPNFB"), x("GDPDEF"))),
    "gdp_deflator_growth": lambda x, o: x.growth(x("GDPDEF")),
    "core_pce_growth": lambda x, o: x.growth(x("PCEPILFE")),
    "nominal_rate": lambda x, o: x("DFF") / 4,
    "consumption_growth": lambda x, o: x.real_growth("PCE", 1000),
    "investment_growth": lambda x, o: x.real_growth("FPI", 10000),
    "baa_10y_spread": lambda x, o: x.spread(),
    "long_inflation_expectations": lambda x, o: x.long_inflation(),
    "long_rate": lambda x, o: x("FYCCZA") / 4,
    "fernald_tfp": lambda x, o: T.utilisation_adjusted(x("TFPKQ"), x("TFPJQ"), x.keys),
    "gdi_growth": lambda x, o: x.real_growth("GDI", 1000),
    "anticipated_rate": first_source,
    "expected_ffr_spd": first_source,
    "flexible_ait_gap": first_source,
    "anticipated_gdp_growth": first_source,
}


def observed(levels: DataFrame, observables: Sequence[Observable], keys: Sequence[str] = (), order: str = "quarter_idx", **settings) -> DataFrame:
    """One column per observable, by the transform it names; a name that isn't registered and levels that aren't there raise before anything runs."""
    if unknown := [f"{o.name}: {o.transform}" for o in observables if o.transform not in FORWARD]:
        raise KeyError(f"unknown forward transforms: {unknown}")
    table = Levels(levels.columns, list(keys), order, settings=settings)
    return levels.select(*keys, order, *[FORWARD[o.transform](table, o).alias(o.name) for o in observables])


def ordered_matrix(df: DataFrame, names: Sequence[str], start: int | None, forecast_start: int, inside: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the sample with the named columns as one array, in the order of names; transform first, then call this, so that growth reaches back before the sample."""
    return sample(df, start, forecast_start, inside).select(*keys, "quarter_idx", F.array(*[F.col(n).cast("double") for n in names]).alias("y"))


def forecast_tail(recorded: DataFrame, forecast: DataFrame, order: str = "quarter_idx") -> DataFrame:
    """Forecast rows from the last recorded quarter on, that quarter included."""
    last = recorded.agg(F.max(order).alias("_last"))  # one row
    return forecast.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(order) >= F.col("_last"))).drop("_last")


def population_helpers(levels: DataFrame, column: str, forecast: DataFrame | None = None, smoothing: float = 1600.0, order: str = "quarter_idx") -> DataFrame:
    """levels with the recorded population's growth, its trend (over the forecast tail too, if there is one) and the trend's growth.

    A forecast that begins in the last recorded quarter repeats it, as its tail includes that
    quarter. The trend is one series' work: a few rows a quarter.
    """
    recorded = levels.select(F.lit("population").alias("series"), F.col(order).alias("q"), F.col(column).cast("double").alias("value"), F.lit(0).alias("part"))
    rows = recorded
    if forecast is not None:
        tail = forecast_tail(levels, forecast, order).select(F.lit("population").alias("series"), F.col(order).alias("q"), F.col(column).cast("double").alias("value"), F.lit(1).alias("part"))
        rows = recorded.unionByName(tail)
    places = rows.withColumn("place", F.struct("q", "part"))
    numbered = places.withColumn("nth", F.expr("row_number() over (partition by series order by place)"))
    smooth = trends(numbered.select("series", "nth", "value"), ["series"], "nth", "value", smoothing)
    filtered = numbered.where("part = 0").join(smooth.select("series", "nth", F.col("trend").alias(FILTERED)), ["series", "nth"]).select(F.col("q").alias(order), FILTERED)
    out = levels.join(filtered, order, "left").withColumn("_series", F.lit("population"))
    growth = {"dlpopulation_recorded": T.log_growth(column, ["_series"], order), "dlfiltered_population_recorded": T.log_growth(FILTERED, ["_series"], order)}
    return out.withColumns(growth).drop("_series")
