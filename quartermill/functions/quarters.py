"""Quarter arithmetic: a quarter is the integer year * 4 + quarter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_index(date) -> Column:
    c = F.col(date) if isinstance(date, str) else date
    return (F.year(c) * 4 + F.quarter(c)).cast("int")


def parse_quarter(text) -> Column:
    """`YYYY-Qn` with n from 1 to 4, or any ISO date; null for anything else."""
    c = F.col(text) if isinstance(text, str) else text
    labelled = F.regexp_extract(c, r"^(\d{4})-Q([1-4])$", 1).try_cast("int") * 4 + F.regexp_extract(c, r"^(\d{4})-Q([1-4])$", 2).try_cast("int")
    return F.coalesce(labelled, quarter_index(c.try_cast("date"))).cast("int")


def quarter_label(index) -> Column:
    c = F.col(index) if isinstance(index, str) else index
    return F.concat(F.floor((c - 1) / 4).cast("string"), F.lit("-Q"), (F.pmod(c - 1, F.lit(4)) + 1).cast("string"))


def quarter_start(index) -> Column:
    c = F.col(index) if isinstance(index, str) else index
    return F.make_date(F.floor((c - 1) / 4).cast("int"), (F.pmod(c - 1, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))


def quarter_end(index) -> Column:
    return F.last_day(F.add_months(quarter_start(index), 2))


def vintage_date(yymmdd) -> Column:
    """A six-digit vintage as a date of this century."""
    c = F.col(yymmdd) if isinstance(yymmdd, str) else yymmdd
    return F.to_date(F.concat(F.lit("20"), c), "yyyyMMdd")
