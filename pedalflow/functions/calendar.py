"""Calendar features of a naive timestamp or date. Weeks start on Monday = 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dow(c: Column) -> Column:
    return F.weekday(c)


def is_weekend(c: Column) -> Column:
    return F.weekday(c) >= 5


def iso_week(c: Column) -> Column:
    return F.weekofyear(c)


# Statutory holidays, as (month, day) and as (month, which Monday).
FIXED_HOLIDAYS = ((1, 1), (5, 1), (9, 16), (12, 25))
MONDAY_HOLIDAYS = ((2, 1), (3, 3), (11, 3))


def is_holiday(c: Column) -> Column:
    """The n-th Monday of a month is the Monday whose day number lies in the n-th block of seven."""
    month, day = F.month(c), F.dayofmonth(c)
    fixed = [(month == m) & (day == d) for m, d in FIXED_HOLIDAYS]
    mondays = [(month == m) & (F.ceil(day / F.lit(7)) == n) & (F.weekday(c) == 0) for m, n in MONDAY_HOLIDAYS]
    found = F.lit(False)
    for rule in fixed + mondays:
        found = found | rule
    return found


def quincena(c: Column) -> Column:
    """Pay day: the 15th or the last day of the month."""
    date = c.cast("date")
    return (F.dayofmonth(date) == 15) | (date == F.last_day(date))


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    days = spark.range(1).select(
        F.explode(
            F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))
        ).alias("date")
    )
    return days.filter(is_holiday(F.col("date")))


def calendar_columns(ts: Column) -> list[Column]:
    return [
        F.hour(ts).alias("hour"),
        dow(ts).alias("dow"),
        is_weekend(ts).alias("is_weekend"),
        F.month(ts).alias("month"),
        iso_week(ts).alias("week"),
        is_holiday(ts).alias("is_holiday"),
        quincena(ts).alias("quincena"),
    ]
