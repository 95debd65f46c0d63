"""Column builders for levels, growth rates and parameters.

Missing is NULL throughout: NaN turns into NULL on the way in, logs of values that aren't
positive and divisions by zero give NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing_as_null(x) -> Column:
    return F.when(~F.isnan(c(x)), c(x))


def safe_log(x) -> Column:
    return F.when(c(x) > 0, F.ln(c(x)))


def ratio(top, under) -> Column:
    return F.try_divide(c(top).cast("double"), c(under))


def previous(value: Column, keys: Sequence[str], order: str, by: int = 1) -> Column:
    return F.lag(value, by).over(Window.partitionBy(*keys).orderBy(order))


def log_growth(x, keys: Sequence[str], order: str) -> Column:
    """100 times the change of the log from the previous row of the series."""
    return 100 * (safe_log(x) - previous(safe_log(x), keys, order))


def difference(x, keys: Sequence[str], order: str) -> Column:
    return c(x) - previous(c(x), keys, order)


def demeaned(x, keys: Sequence[str]) -> Column:
    return c(x) - F.avg(c(x)).over(Window.partitionBy(*keys))


def real(x, deflator) -> Column:
    return ratio(c(x), deflator) * 100


def per_capita(x, population) -> Column:
    return ratio(x, population)


def spliced(base, replacement, quarter, since: int) -> Column:
    """replacement from quarter `since` on where there is one, else base."""
    return F.when((c(quarter) >= since) & c(replacement).isNotNull(), c(replacement)).otherwise(c(base))


def annual_to_quarter(x) -> Column:
    return c(x) / 4


def quarter_to_annual(x) -> Column:
    return c(x) * 4


def growth_to_annual_percent(x) -> Column:
    """A quarterly log growth rate in percent as an annual percentage."""
    return 400 * (F.exp(c(x) / 100) - 1)


def identity(x) -> Column:
    return c(x)


#: Transforms from the model's units to those of reports, by name.
REVERSE: dict[str, Callable[[Column], Column]] = {
    "identity": identity,
    "annual_to_quarter": annual_to_quarter,
    "quarter_to_annual": quarter_to_annual,
    "loggrowth_to_pct_annualized": growth_to_annual_percent,
    "loggrowth_to_pct_annualized_percapita": growth_to_annual_percent,
}


def by_name(name, x, registry: dict[str, Callable[[Column], Column]] = REVERSE) -> Column:
    """The transform that each row names; a name that isn't registered raises."""
    out = None
    for key, f in registry.items():
        out = F.when(c(name) == key, f(c(x))) if out is None else out.when(c(name) == key, f(c(x)))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown transform: "), c(name))).cast("double"))


#: Forward transforms: raw levels to observables. Each takes names of levels and the window of a series.
def hours_worked(hours, employment, population) -> Column:
    """Log of average weekly hours per head, in percent."""
    return 100 * safe_log(ratio(3 * c(hours) * c(employment), population) / 100)


def real_growth_per_capita(x, population, deflator, keys, order, scale: float = 1000) -> Column:
    return log_growth(real(ratio(scale * c(x), population), deflator), keys, order)


def expected_inflation(ten_year, wedge: float = 0.5) -> Column:
    return (c(ten_year) - wedge) / 4


def utilisation_adjusted(x, share, keys) -> Column:
    """Demeaned growth over four times the labour share's complement."""
    return ratio(demeaned(x, keys), 4 * (1 - c(share)))


#: From a parameter's stated value to the value in the equations.
SCALINGS: dict[str, Callable[[Column], Column]] = {
    "identity": identity,
    "discount": lambda x: 1 / (1 + x / 100),
    "gross": lambda x: 1 + x / 100,
    "fomega": lambda x: 1 - F.pow(1 - x, F.lit(0.25)),
    "quarterly_spread": lambda x: F.pow(1 + x / 100, F.lit(0.25)),
    "percent": lambda x: x / 100,
}


def to_model(kind, x, low, high) -> Column:
    """From the whole line to the parameter's domain."""
    k, x = c(kind), c(x)
    logistic = c(low) + (c(high) - c(low)) / (1 + F.exp(-x))
    return F.when(k == "exponential", F.exp(x)).when(k == "bounded", logistic).when(k == "square", x * x).otherwise(x)


def to_line(kind, v, low, high) -> Column:
    """The inverse of to_model; null outside the domain."""
    k, v = c(kind), c(v)
    logit = F.when((v > c(low)) & (v < c(high)), safe_log((v - c(low)) / (c(high) - v)))
    root = F.when(v >= 0, F.sqrt(v))
    return F.when(k == "exponential", safe_log(v)).when(k == "bounded", logit).when(k == "square", root).otherwise(v)


def to_line_checked(kind, v, low, high) -> Column:
    """to_line that fails the query for a value outside the parameter's domain; null stays null."""
    line = to_line(kind, v, low, high)
    fault = F.raise_error(F.concat(F.lit("outside its domain: "), c(v).cast("string"), F.lit(" "), c(kind)))
    return F.when(c(v).isNull(), F.lit(None).cast("double")).when(line.isNotNull(), line).otherwise(fault.cast("double"))


def shown(x, places: int = 3) -> Column:
    """A number as tables show it: ties go to the even digit."""
    return F.bround(x, places)


def log_prior(name, x, a, b, log_norm) -> Column:
    """Log density of a prior given its two shape numbers and the log of its normaliser.

    normal(mean a, deviation b), uniform(a, b), gamma(shape a, scale b), beta(a, b),
    inverse gamma root (degrees a, scale b). log_norm comes from prior_normaliser.
    """
    n, x, a, b = c(name), c(x), c(a), c(b)
    z = (x - a) / b
    normal = -0.5 * z * z
    uniform = F.when((x >= a) & (x <= b), F.lit(0.0))
    gamma = (a - 1) * safe_log(x) - x / b
    beta = F.when((x > 0) & (x < 1), (a - 1) * safe_log(x) + (b - 1) * safe_log(1 - x))
    inverse = F.when(x > 0, -(a + 1) * safe_log(x) - a * b * b / (2 * x * x))
    kernel = F.when(n == "normal", normal).when(n == "uniform", uniform).when(n == "gamma", gamma).when(n == "beta", beta).when(n == "root_inverse_gamma", inverse)
    return kernel + c(log_norm)


def by_moments(name: str, mean: float, std: float) -> tuple[str, float, float]:
    """A gamma or beta prior given by its mean and deviation, as (name, a, b) of log_prior."""
    if mean <= 0 or std <= 0:
        raise ValueError("mean and deviation are positive")
    if name == "gamma":
        return "gamma", (mean / std) ** 2, std**2 / mean
    if name == "beta":
        weight = mean * (1 - mean) / std**2 - 1
        if weight <= 0:
            raise ValueError("no beta has this mean and deviation")
        return "beta", mean * weight, (1 - mean) * weight
    raise ValueError(f"not a gamma or beta: {name}")


def horizons(values: Column, fallback: Column) -> Column:
    """Sorted distinct horizons of a map regime -> horizons, or of fallback where there are none; one that isn't positive fails the query."""
    own = F.flatten(F.map_values(values))
    used = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(F.coalesce(fallback, F.array().cast("array<int>")))
    sound = F.when(F.exists(used, lambda h: h <= 0), F.raise_error(F.lit("horizons are positive")).cast("boolean")).otherwise(F.lit(True))
    return F.when(sound, F.array_sort(F.array_distinct(used)))


def prior_normaliser(name: str, a: float, b: float) -> float:
    """The part of a log prior that doesn't depend on the value; once per parameter, on the driver."""
    from math import lgamma, log, pi

    if name == "normal":
        return -log(b) - 0.5 * log(2 * pi)
    if name == "uniform":
        return -log(b - a)
    if name == "gamma":
        return -lgamma(a) - a * log(b)
    if name == "beta":
        return lgamma(a + b) - lgamma(a) - lgamma(b)
    if name == "root_inverse_gamma":
        return log(2) - lgamma(a / 2) + a / 2 * log(a * b * b / 2)
    raise ValueError(f"unknown prior: {name}")
