"""Reports that follow a fact month by month, with exact distinct counts.

Of each month of the fact a small table of sums and one of bitmaps is kept: sums by day, title and
auditorium and by time slot, and of customers, movies and the showtimes of each title which ids
occur. Sums add up, bitmaps are or-ed, so reports over all months read no other month's facts than
those that have changed. Days lie in one month each and need no bitmap.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import MONEY_TOTAL, money_sum
from ..sinks import files
from ..sinks.publish import publish
from ..sinks.tables import overwrite_partitions
from ..sources.schemas import MONTH
from ..sources.snapshots import read_fact

DAYS = f"booking_date date, movie_title string, auditorium_name string, revenue {MONEY_TOTAL}, seats long, n long, {MONTH}"
SLOTS = f"time_of_day string, day_of_week string, revenue {MONEY_TOTAL}, seats long, n long, {MONTH}"
IDS = f"kind string, movie_title string, bucket long, bitmap binary, {MONTH}"
_MONTH = ["year", "month_num"]


def _sums(fact: DataFrame, *keys: str) -> DataFrame:
    return fact.groupBy(*_MONTH, *keys).agg(
        money_sum("total_revenue").alias("revenue"),
        F.sum("seats_booked").alias("seats"),
        F.count(F.lit(1)).alias("n"),
    )


def _ids(fact: DataFrame) -> DataFrame:
    """Bitmaps of the ids of each month, 32,768 ids to a bitmap."""
    none = F.lit(None).cast("string")
    kinds = {"customer": ("customer_id", none), "movie": ("movie_id", none), "showtime": ("showtime_id", F.col("movie_title"))}
    named = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), title.alias("movie_title"), F.col(key).alias("key"))
            for kind, (key, title) in kinds.items()
        ]
    )
    each = fact.select(*_MONTH, F.inline(named)).filter(F.col("key").isNotNull())
    return each.groupBy(*_MONTH, "kind", "movie_title", F.bitmap_bucket_number("key").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("bitmap")
    )


class Partials:
    """The monthly tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def refresh(self, fact_path: str, months: Iterable[tuple[int, int]] | None = None) -> None:
        """Recompute the given (year, month) of the published fact, or all; doing it twice changes
        nothing. A month that has left the fact leaves the tables."""
        fact = read_fact(self.spark, fact_path)
        if months is not None:
            months = sorted(set(months))
            wanted = F.lit(False)
            for year, month in months:
                wanted |= (F.col("year") == year) & (F.col("month_num") == month)
            fact = fact.filter(wanted)
        else:
            for name in ("days", "slots", "ids"):
                files.remove(self.spark, f"{self.path}/{name}")
        tables = {
            "days": _sums(fact, "booking_date", "movie_title", "auditorium_name"),
            "slots": _sums(fact, "time_of_day", "day_of_week"),
            "ids": _ids(fact),
        }
        if months is not None:
            left = {tuple(r) for r in fact.select(*_MONTH).distinct().collect()}
            for year, month in set(months) - left:
                for name in tables:
                    files.remove(self.spark, f"{self.path}/{name}/year={year}/month_num={month}")
        for name, table in tables.items():
            files.make_folder(self.spark, f"{self.path}/{name}")
            overwrite_partitions(table, f"{self.path}/{name}", _MONTH)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _distinct(self, kind: str, *by: str) -> DataFrame:
        """How many different ids of a kind there are, in all months, by ``by``."""
        ids = self._read("ids", IDS).filter(F.col("kind") == kind)
        whole = ids.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        return whole.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).alias(f"{kind}s"))

    # -- reports, as over the whole fact ------------------------------------------------------

    def mv_daily_revenue(self) -> DataFrame:
        days = self._read("days", DAYS)
        return days.select(
            "booking_date",
            "movie_title",
            "auditorium_name",
            F.col("revenue").alias("total_revenue"),
            F.col("seats").alias("total_seats"),
            F.col("n").alias("total_bookings"),
            _average("revenue", "n").alias("avg_transaction_value"),
        ).orderBy(F.desc("booking_date"), F.desc("total_revenue"), "movie_title", "auditorium_name")

    def mv_movie_performance(self) -> DataFrame:
        sums = self._read("days", DAYS).groupBy("movie_title").agg(
            F.countDistinct("booking_date").alias("days_shown"),
            F.sum("seats").alias("total_seats_sold"),
            money_sum("revenue").alias("total_revenue"),
            F.sum("n").alias("n"),
        )
        shows = self._distinct("showtime", "movie_title").withColumnRenamed("movie_title", "of")
        return (
            sums.join(shows, F.col("movie_title").eqNullSafe(F.col("of")), "left")
            .select(
                "movie_title",
                "days_shown",
                "total_seats_sold",
                "total_revenue",
                _average("total_seats_sold", "n").alias("avg_seats_per_booking"),
                F.coalesce("showtimes", F.lit(0)).cast("long").alias("total_showtimes"),
            )
            .orderBy(F.desc("total_revenue"), "movie_title")
        )

    def mv_timeslot_analysis(self) -> DataFrame:
        return (
            self._read("slots", SLOTS)
            .groupBy("time_of_day", "day_of_week")
            .agg(
                F.sum("n").alias("booking_count"),
                money_sum("revenue").alias("total_revenue"),
                F.try_divide(F.sum("seats").cast("double"), F.sum("n")).alias("avg_seats_per_booking"),
            )
            .orderBy(F.desc("booking_count"), "time_of_day", "day_of_week")
        )

    def _one(self, kind: str) -> DataFrame:
        return self._distinct(kind).select(F.coalesce(f"{kind}s", F.lit(0)).cast("long").alias(f"{kind}s"))

    def _totals(self) -> DataFrame:
        return self._read("days", DAYS).agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"),
            F.sum("seats").alias("seats"),
            money_sum("revenue").alias("revenue"),
            F.min("booking_date").alias("earliest_booking"),
            F.max("booking_date").alias("latest_booking"),
        )

    def analytics_summary(self) -> DataFrame:
        """One row of totals, also for an empty fact."""
        return self._totals().join(self._one("customer")).select(
            F.col("customers").alias("total_customers"),
            F.col("n").alias("total_bookings"),
            F.col("seats").alias("total_seats_sold"),
            F.col("revenue").alias("total_revenue"),
            _average("revenue", "n").alias("avg_booking_value"),
        )

    def etl_summary(self) -> DataFrame:
        return self._totals().join(self._one("customer")).join(self._one("movie")).select(
            F.col("n").alias("total_fact_records"),
            F.col("seats").alias("total_seats"),
            F.col("revenue").alias("total_revenue"),
            "earliest_booking",
            "latest_booking",
            F.col("customers").alias("unique_customers"),
            F.col("movies").alias("unique_movies"),
        )


def _average(total: str, n: str) -> Column:
    return F.try_divide(F.col(total).cast("double"), F.col(n))


REPORTS = ("mv_daily_revenue", "mv_movie_performance", "mv_timeslot_analysis", "analytics_summary", "etl_summary")


def refresh_changed_months(
    spark: SparkSession, fact_path: str, partials_path: str, reports_path: str, months: Iterable[tuple[int, int]] | None
) -> dict[str, str]:
    """Bring the monthly tables up to date and publish all reports; gives their folders."""
    partials = Partials(spark, partials_path)
    partials.refresh(fact_path, months)
    root = reports_path.rstrip("/")
    return {name: publish(getattr(partials, name)(), f"{root}/{name}", (), ()) for name in REPORTS}
