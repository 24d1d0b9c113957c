"""Calendar attributes and time-of-day labels, all as JVM-side column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Col = Column | str


def _col(value: Col) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ntz(moment: datetime) -> Column:
    """Literal timestamp without time zone, whatever zone the driver runs in."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def day_number(day: Col) -> Column:
    """Weekday with 0 = Sunday .. 6 = Saturday (Spark's own numbering starts at 1)."""
    return F.dayofweek(_col(day)) - 1


def is_weekend(day: Col) -> Column:
    return day_number(day).isin(0, 6)


def day_name(day: Col, pg_padded: bool = False) -> Column:
    """English weekday name; ``pg_padded`` blank-pads it to nine characters."""
    name = F.date_format(_col(day), "EEEE")
    return F.rpad(name, 9, " ") if pg_padded else name


def month_name(day: Col, pg_padded: bool = False) -> Column:
    name = F.date_format(_col(day), "MMMM")
    return F.rpad(name, 9, " ") if pg_padded else name


def clock_time(ts: Col) -> Column:
    return F.date_format(_col(ts), "HH:mm:ss")


def calendar_columns(ts: Col, pg_padded: bool = False) -> list[Column]:
    """The calendar attributes of one timestamp.

    ``week_of_year`` is the ISO week while ``year`` is the calendar year, so
    30 December 2024 is week 1 of year 2024.
    """
    ts = _col(ts)
    return [
        F.to_date(ts).alias("booking_date"),
        clock_time(ts).alias("booking_time"),
        day_name(ts, pg_padded).alias("day_of_week"),
        F.weekofyear(ts).alias("week_of_year"),
        F.month(ts).alias("month_num"),
        month_name(ts, pg_padded).alias("month_name"),
        F.year(ts).alias("year"),
        F.quarter(ts).alias("quarter"),
        is_weekend(ts).alias("is_weekend"),
    ]


def time_of_day_etl(hour: Col) -> Column:
    """Five labels used while loading the fact; they describe the hour of payment."""
    h = _col(hour)
    return (
        F.when(h.between(0, 5), "Late Night")
        .when(h.between(6, 11), "Morning")
        .when(h.between(12, 17), "Afternoon")
        .when(h.between(18, 21), "Evening")
        .otherwise("Night")
    )


# Half-open hour ranges and their labels; any other hour, or none, is 'Night'.
DAY_RANGES = ((6, 12, "Morning"), (12, 17, "Afternoon"), (17, 21, "Evening"))


def time_of_day_fn(hour: Col) -> Column:
    """Four labels over half-open hour ranges; a null hour is 'Night'."""
    h, label = _col(hour), F.lit("Night")
    for start, end, name in DAY_RANGES:
        label = F.when((h >= start) & (h < end), name).otherwise(label)
    return label


def slot4(hour: Col) -> Column:
    """Four report labels; 'Night' runs from 22:00 to 05:59."""
    h = _col(hour)
    return (
        F.when(h.between(6, 11), "Morning")
        .when(h.between(12, 17), "Afternoon")
        .when(h.between(18, 21), "Evening")
        .otherwise("Night")
    )


def day_type(day: Col) -> Column:
    number = day_number(day)
    return F.when(number.isin(0, 6), "Weekend").when(number == 5, "Friday").otherwise("Weekday")


def register_sql_functions(spark: SparkSession) -> None:
    """Make the half-open labels callable from SQL text as ``get_time_of_day(hour)``."""
    ranges = " ".join(
        f"WHEN showtime_hour >= {start} AND showtime_hour < {end} THEN '{name}'"
        for start, end, name in DAY_RANGES
    )
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION get_time_of_day(showtime_hour INT)
        RETURNS STRING
        RETURN CASE {ranges} ELSE 'Night' END
        """
    )


def at_time(day: Col, hours: Col, minutes: Col) -> Column:
    """Midnight of ``day`` plus whole hours and minutes."""
    midnight = F.date_trunc("day", _col(day)).cast("timestamp_ntz")
    return F.timestamp_add("MINUTE", _col(minutes), F.timestamp_add("HOUR", _col(hours), midnight))


def shift(ts: Col, unit: str, amount: Col | int) -> Column:
    quantity = F.lit(amount) if isinstance(amount, int) else _col(amount)
    return F.timestamp_add(unit, quantity, _col(ts))


def date_spine(as_of: Col, days: int = 7) -> Column:
    """Array of ``days`` consecutive dates from ``as_of`` as 'yyyy-MM-dd' text."""
    start = _col(as_of)
    spine = F.sequence(start, F.date_add(start, days - 1), F.expr("INTERVAL 1 DAY"))
    return F.transform(spine, lambda d: F.date_format(d, "yyyy-MM-dd"))


def short_date(day: Col) -> Column:
    return F.date_format(_col(day), "MMM d")


def long_date(day: Col) -> Column:
    return F.date_format(_col(day), "MMMM d, yyyy")


def weekday_date(day: Col) -> Column:
    return F.date_format(_col(day), "EEE, MMM d")
