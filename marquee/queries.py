"""Registered queries: every operator run over whole tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calendar as cal
from .functions import documents as docs
from .functions import numeric as num
from .operators import (
    admission,
    customers,
    dashboard,
    distributions,
    integrity,
    latency,
    reports,
    sampling,
    seating,
)
from .plans import dimensions, fact, load, partials, reconciliation
from .session import configure, ensure_checkpoint_dir, stored
from .sinks.json_rows import to_json_rows
from .sinks.publish import publish
from .sinks.tables import append_ignore_duplicates, append_with_defaults
from .sources.generators import build_seats, build_showtimes, date_sequence, explode_int_series
from .sources.schemas import FACT_NOT_NULL, OPERATIONAL, PAYMENT_DEFAULTS
from .sources.snapshots import read_fact
from .sources.trade_tables import TradeTables
from .streaming.follow import FactFollower

AS_OF = date(2001, 8, 1)
HOLDS_AS_OF = datetime(1998, 6, 1)
SHOW_DATE = date(2024, 1, 3)
SEED = 7
PICK_SEATS = 3
SHOWTIME = 7
# The fact is rebuilt in two parts, before and from this day on.
REBUILT_FROM = date(1997, 1, 1)
# Months whose reports are refreshed, and buckets of the stores that follow a feed here.
STALE = [(1996, 5), (1997, 2)]
FOLLOW_BUCKETS = 4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _register(name: str, run: Callable[[TradeTables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(TradeTables(configure(spark), sf_dir))


def _query(run: Callable[[TradeTables], DataFrame]) -> Callable[[TradeTables], DataFrame]:
    """Register a query under the name of its function."""
    _register(run.__name__.rstrip("_"), run)
    return run


def _each(source: Callable[[TradeTables], object], *operators: Callable[..., DataFrame]) -> None:
    """Register operators that take nothing but one input, under their own names."""
    for operator in operators:
        _register(operator.__name__, lambda t, operator=operator: operator(source(t)))


def _fact(t: TradeTables) -> DataFrame:
    return fact.fact_bookings(t.booking_model())


# -- facts, reports, dashboard ------------------------------------------------------------


@_query
def fact_bookings(t: TradeTables) -> DataFrame:
    return _fact(t).drop("id")


def _published(t: TradeTables) -> tuple[str, DataFrame]:
    """The fact published in the shared folder, and the summary of its load."""
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/fact-{uuid.uuid4().hex}"
    return path, load.load_fact(t.spark, t.booking_model(), path)


@_query
def load_fact(t: TradeTables) -> DataFrame:
    """Summary of the whole load job."""
    return _published(t)[1]


def _refreshed(t: TradeTables) -> partials.Partials:
    """Monthly tables made from a fact that lacks bookings of one month and has a month too many
    seats, and brought up to date with these two months. The fact is built once for both."""
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    _fact(t).write.parquet(f"{folder}/whole")
    whole = read_fact(t.spark, f"{folder}/whole")
    first = (F.col("year") == STALE[0][0]) & (F.col("month_num") == STALE[0][1])
    second = (F.col("year") == STALE[1][0]) & (F.col("month_num") == STALE[1][1])
    stale = whole.filter(~first | (F.col("id") % 3 == 0)).withColumn(
        "seats_booked", F.when(second, F.col("seats_booked") + 1).otherwise(F.col("seats_booked"))
    )
    found = partials.Partials(t.spark, f"{folder}/partials")
    publish(stale, f"{folder}/fact")
    found.refresh(f"{folder}/fact")
    publish(whole, f"{folder}/fact")
    found.refresh(f"{folder}/fact", STALE)
    return found


@_query
def mv_movie_performance_refreshed(t: TradeTables) -> DataFrame:
    return _refreshed(t).mv_movie_performance()


@_query
def analytics_summary_refreshed(t: TradeTables) -> DataFrame:
    return _refreshed(t).analytics_summary()


def _model_feed(t: TradeTables) -> list[DataFrame]:
    """The booking model as three micro-batches of a change feed: tickets, holds and showtimes
    with old attributes; then old customers, movies, auditoriums and all payments; last the
    changes of every showtime, customer, movie and auditorium that was old."""
    m = t.booking_model()
    old = F.col("id") % 3 == 0

    def rows(table: str, stale: dict[str, Column], kind: str, version: int) -> DataFrame:
        df = m[table]
        if kind == "UPDATE":
            df = df.filter(old)
        elif stale:
            df = df.withColumns({c: F.when(old, value).otherwise(F.col(c)) for c, value in stale.items()})
        return df.withColumns(
            {"change_kind": F.lit(kind), "change_version": F.lit(version).cast("long"), "table": F.lit(table)}
        )

    stale = {
        "showtimes": {"start_time": cal.shift("start_time", "MINUTE", 30)},
        "customers": {"name": F.lit("old name")},
        "movies": {"title": F.lit("old title"), "price": F.lit("1.00").cast("decimal(10,2)")},
        "auditoriums": {"name": F.lit("old hall")},
    }
    batches = [
        [rows(n, stale.get(n, {}), "INSERT", 1) for n in names]
        for names in (
            ("tickets", "reservation_holds", "showtimes"),
            ("customers", "movies", "auditoriums", "payments"),
        )
    ]
    batches.append([rows(n, {}, "UPDATE", 2) for n in stale])
    return [reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) for parts in batches]


@_query
def fact_bookings_followed(t: TradeTables) -> DataFrame:
    """The fact kept by signed deltas over a feed in which children come before their parents and
    all four dimensions change afterwards."""
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/follow-{uuid.uuid4().hex}"
    follower = FactFollower(t.spark, f"{folder}/state", f"{folder}/fact", FOLLOW_BUCKETS)
    for number, batch in enumerate(_model_feed(t)):
        follower.apply(batch, number)
    return read_fact(t.spark, f"{folder}/fact").drop("id")


@_query
def daily_revenue_published(t: TradeTables) -> DataFrame:
    """Revenue of the last days from the months of the published fact that hold them."""
    return load.recent_revenue(t.spark, _published(t)[0], AS_OF)


@_query
def fact_rebuilt_by_month(t: TradeTables) -> DataFrame:
    """Rows, ids and ids in common with the whole fact, per month of a fact built in two parts."""
    m = t.booking_model()
    day = F.to_date("payment_date")
    parts = [
        fact.fact_bookings({**{n: m[n] for n in OPERATIONAL}, "payments": m["payments"].filter(which)})
        for which in (day < F.lit(REBUILT_FROM), day >= F.lit(REBUILT_FROM))
    ]
    rebuilt = parts[0].unionByName(parts[1])
    whole = fact.fact_bookings(m).select("id", "booking_timestamp", "showtime_id", F.lit(1).alias("same"))
    return (
        rebuilt.join(whole, ["id", "booking_timestamp", "showtime_id"], "left")
        .groupBy("year", "month_num")
        .agg(
            F.count(F.lit(1)).alias("fact_rows"),
            F.countDistinct("id").alias("ids"),
            F.count("same").alias("same_ids"),
        )
    )


@_query
def daily_revenue(t: TradeTables) -> DataFrame:
    return reports.daily_revenue(_fact(t), AS_OF)


_each(
    _fact,
    reports.analytics_summary,
    reports.top_movies,
    reports.timeslots,
    reports.mv_daily_revenue,
    reports.mv_movie_performance,
    reports.mv_timeslot_analysis,
    reports.etl_summary,
    reports.booking_distribution,
    dashboard.time_of_day_totals,
    dashboard.time_of_day_ordered,
    dashboard.movies_pct_of_max,
    dashboard.slots_pct_of_max,
)

# -- payments and tickets -----------------------------------------------------------------

_each(
    TradeTables.payments,
    distributions.booking_stats,
    distributions.slot_distribution,
    distributions.day_type_distribution,
    distributions.repeat_rate,
)


@_query
def seats_per_booking(t: TradeTables) -> DataFrame:
    return distributions.seats_per_booking(t.tickets())


# -- integrity and reconciliation ---------------------------------------------------------

_each(
    TradeTables.booking_model,
    fact.booking_lines,
    integrity.integrity_not_null,
    integrity.integrity_text_length,
    integrity.integrity_unique,
    integrity.integrity_foreign_keys,
    integrity.payments_without_tickets,
    integrity.payment_amount_mismatch,
)


@_query
def integrity_fact_not_null(t: TradeTables) -> DataFrame:
    return integrity.integrity_not_null({"fact_bookings": _fact(t)}, {"fact_bookings": FACT_NOT_NULL})


@_query
def double_bookings(t: TradeTables) -> DataFrame:
    return integrity.double_bookings(t.reservation_holds())


@_query
def recon_counts(t: TradeTables) -> DataFrame:
    return reconciliation.recon_counts(t.payments(), _fact(t))


@_query
def recon_payments_vs_fact(t: TradeTables) -> DataFrame:
    m = t.booking_model()
    return reconciliation.recon_payments_vs_fact(m, fact.fact_bookings(m))


@_query
def feed_freshness(t: TradeTables) -> DataFrame:
    return reconciliation.feed_freshness(t.payments(), _fact(t))


# -- seats --------------------------------------------------------------------------------

_each(TradeTables.booking_model, seating.seat_map, seating.available_seats, seating.seat_occupancy)


@_query
def available_seat_arrays(t: TradeTables) -> DataFrame:
    """The array as one text, which every engine compares alike."""
    text = F.array_join(F.transform("seat_ids", lambda s: s.cast("string")), ",")
    return seating.available_seat_arrays(t.booking_model()).withColumn("seat_ids", text)


@_query
def schedule(t: TradeTables) -> DataFrame:
    return seating.schedule(t.booking_model(), SHOW_DATE)


@_query
def hold_status_counts(t: TradeTables) -> DataFrame:
    return seating.hold_status_counts(t.reservation_holds(), HOLDS_AS_OF)


@_query
def active_holds(t: TradeTables) -> DataFrame:
    return seating.active_holds(t.reservation_holds(), HOLDS_AS_OF)


@_query
def released_holds(t: TradeTables) -> DataFrame:
    return seating.released_holds(t.reservation_holds(), HOLDS_AS_OF)


@_query
def seat_map_of(t: TradeTables) -> DataFrame:
    return seating.seat_map_of(t.booking_model(), SHOWTIME)


@_query
def slot_first_claim(t: TradeTables) -> DataFrame:
    return seating.slot_first_claim(admission.explode_requests(t.booking_requests()))


@_query
def pick_available_seats(t: TradeTables) -> DataFrame:
    return sampling.pick_available_seats(t.booking_model(), PICK_SEATS, SEED)


@_query
def weighted_pick(t: TradeTables) -> DataFrame:
    requests = t.payments().select(F.col("id").alias("request_id"))
    return sampling.weighted_pick(requests, t.movies(), SEED)


@_query
def random_showtime_for_movie(t: TradeTables) -> DataFrame:
    m = t.booking_model()
    shows = m["showtimes"].select(F.col("id").alias("showtime_id"), "movie_id")
    wanted = t.booking_requests().join(shows, "showtime_id").select("request_id", "movie_id")
    return sampling.random_showtime_for_movie(wanted, m, SEED)


# -- booking pipeline ---------------------------------------------------------------------


@_query
def explode_requests(t: TradeTables) -> DataFrame:
    return admission.explode_requests(t.booking_requests())


def _known(t: TradeTables) -> dict[str, DataFrame]:
    return {"showtimes": t.showtimes(), "seats": t.seats()}


@_query
def admit_bookings(t: TradeTables) -> DataFrame:
    return admission.admit_bookings(t.booking_requests(), **_known(t))


@_query
def admit_bookings_with_holds(t: TradeTables) -> DataFrame:
    active = seating.active_holds(t.reservation_holds(), HOLDS_AS_OF)
    return admission.admit_bookings(t.booking_requests(), active, **_known(t))


@_query
def admit_bookings_invalid(t: TradeTables) -> DataFrame:
    """Admission where some requests lack an e-mail or amount or name an unknown showtime or seat."""
    number = F.col("request_id")
    first = F.transform("seats", lambda s, i: s.withField("id", F.when(i == 0, -s["id"] - 1).otherwise(s["id"])))
    spoilt = t.booking_requests().withColumns(
        {
            "customer_email": F.when(number % 11 != 0, F.col("customer_email")),
            "payment_amount": F.when(number % 13 != 0, F.col("payment_amount")),
            "showtime_id": F.when(number % 17 == 0, -F.col("showtime_id") - 1).otherwise(F.col("showtime_id")),
            "seats": F.when(number % 19 == 0, first).otherwise(F.col("seats")),
        }
    )
    return admission.admit_bookings(spoilt, **_known(t))


def _held(t: TradeTables, reuse_expired: bool) -> dict[str, DataFrame]:
    return admission.hold_seats(
        t.booking_requests(), t.reservation_holds(), HOLDS_AS_OF, reuse_expired, t.customers(), **_known(t)
    )


@_query
def hold_seats(t: TradeTables) -> DataFrame:
    return _held(t, False)["decisions"]


@_query
def hold_seats_reuse_expired(t: TradeTables) -> DataFrame:
    return _held(t, True)["reservation_holds"]


@_query
def hold_seats_unpaid(t: TradeTables) -> DataFrame:
    """Holds of requests that carry no amount, and on every third request no e-mail."""
    requests = t.booking_requests().withColumns(
        {
            "payment_amount": F.lit(None).cast("decimal(10,2)"),
            "customer_email": F.when(F.col("request_id") % 3 != 0, F.col("customer_email")),
        }
    )
    held = admission.hold_seats(requests, t.reservation_holds(), HOLDS_AS_OF, True, t.customers(), **_known(t))
    return held["reservation_holds"]


@_query
def booking_outputs(t: TradeTables) -> DataFrame:
    """The rows of all accepted requests side by side, joined by their new ids.

    Only customers of the AUTOMOBILE segment are known, the others are made. New ids depend on
    hashes and are left out, but every join on them must find its one row.
    """
    requests = stored(t.booking_requests())
    m = dict(t.booking_model(), **{n: getattr(t, n)() for n in ("payments", "reservation_holds", "tickets")})
    m["customers"] = _automobile(t)
    decisions = admission.admit_bookings(requests, **_known(t))
    made = admission.booking_outputs(requests, decisions, m)
    holds = made["reservation_holds"].withColumnRenamed("id", "reservation_id")
    tickets = made["tickets"].drop("id", "request_id")
    payments = made["payments"].withColumnRenamed("id", "payment_id").drop("request_id")
    people = (
        m["customers"].select("id", "email", F.lit(False).alias("is_new"))
        .unionByName(made["customers"].select("id", "email", F.lit(True).alias("is_new")))
        .withColumnRenamed("id", "customer_id")
    )
    # customers meet payments, which are fewer than their holds and tickets
    paid = payments.join(people, "customer_id")
    return (
        holds.join(tickets, "reservation_id")
        .join(paid, ["payment_id", "customer_id"])
        .drop("reservation_id", "payment_id", "customer_id")
    )


@_query
def conflict_report(t: TradeTables) -> DataFrame:
    requests = t.booking_requests()
    return admission.conflict_report(requests, admission.admit_bookings(requests, **_known(t)))


@_query
def conflicts_per_showtime(t: TradeTables) -> DataFrame:
    requests = t.booking_requests()
    return admission.conflicts_per_showtime(requests, admission.admit_bookings(requests, **_known(t)))


def _automobile(t: TradeTables) -> DataFrame:
    """Customers of the AUTOMOBILE segment."""
    segment = t.customer.filter("c_mktsegment = 'AUTOMOBILE'").select(F.col("c_custkey").alias("id"))
    return t.customers().join(segment, "id", "left_semi")


@_query
def upsert_customers(t: TradeTables) -> DataFrame:
    """Customers of the AUTOMOBILE segment are known, all others come with their requests."""
    merged = customers.upsert_customers(_automobile(t), t.booking_requests())
    return merged.withColumn("id", F.when(~F.col("is_new"), F.col("id"))).withColumnRenamed(
        "id", "known_id"
    )


@_query
def order_total(t: TradeTables) -> DataFrame:
    prices = t.showtimes().join(t.movies().select(F.col("id").alias("movie_id"), "price"), "movie_id")
    return (
        t.booking_requests()
        .join(prices.select(F.col("id").alias("showtime_id"), "price"), "showtime_id")
        .select("request_id", num.order_total("seats", "price").alias("total"))
    )


# -- dimensions and generators ------------------------------------------------------------


@_query
def dim_movies(t: TradeTables) -> DataFrame:
    return dimensions.dim_movies(t.movies(), F.lit(AS_OF.isoformat()))


@_query
def dim_time(t: TradeTables) -> DataFrame:
    """Calendar around all payment days; the payment days themselves are already loaded."""
    day = F.to_date("payment_date")
    bounds = t.payments().agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    loaded = dimensions.calendar_days(t.payments().select(day.alias("date")).distinct())
    return dimensions.dim_time(bounds, loaded)


@_query
def int_series(t: TradeTables) -> DataFrame:
    """Seat ordinals 1..n of every booking."""
    sizes = t.tickets().groupBy("payment_id").agg(F.count(F.lit(1)).alias("n"))
    return explode_int_series(sizes, "n", "ordinal").drop("n")


@_query
def date_series(t: TradeTables) -> DataFrame:
    """Days from each customer's first to last payment."""
    day = F.to_date("payment_date")
    spans = t.payments().groupBy("customer_id").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return date_sequence(spans, "lo", "hi").groupBy("date").agg(F.count(F.lit(1)).alias("customers"))


@_query
def date_spine(t: TradeTables) -> DataFrame:
    days = t.payments().select(F.to_date("payment_date").alias("as_of")).distinct()
    return days.select("as_of", F.posexplode(cal.date_spine("as_of")).alias("offset", "day"))


_each(TradeTables.auditoriums, build_seats)


@_query
def build_showtimes_(t: TradeTables) -> DataFrame:
    return build_showtimes(t.movies(), date(2024, 1, 1), F.col("id") % 10, seed=SEED)


# -- sinks that return rows ---------------------------------------------------------------


@_query
def append_ignore_duplicates_(t: TradeTables) -> DataFrame:
    """Every part offered as a movie; ids already there stay as they are."""
    offered = t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("title"),
        F.col("p_size").alias("duration_minutes"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
    )
    return append_ignore_duplicates(t.movies(), offered, ["id"])


@_query
def append_with_defaults_(t: TradeTables) -> DataFrame:
    """Second copies of all payments that lack date and method."""
    bare = t.payments().select((-F.col("id") - 1).alias("id"), "customer_id", "amount")
    defaults = {**PAYMENT_DEFAULTS, "payment_date": cal.ntz(HOLDS_AS_OF)}
    return append_with_defaults(t.payments(), bare, defaults)


@_query
def to_json_rows_(t: TradeTables) -> DataFrame:
    """Payments per day as JSON documents."""
    per_day = t.payments().groupBy(F.to_date("payment_date").alias("booking_date")).agg(
        num.money_sum("amount").alias("daily_revenue"), F.count(F.lit(1)).alias("bookings")
    )
    return to_json_rows(per_day)


# -- scalar functions ---------------------------------------------------------------------


@_query
def calendar_columns(t: TradeTables) -> DataFrame:
    return t.payments().select("id", *cal.calendar_columns("payment_date"))


for _label in (cal.time_of_day_etl, cal.time_of_day_fn, cal.slot4):
    _register(
        _label.__name__,
        lambda t, label=_label: t.payments().select(
            "id", label(F.hour("payment_date")).alias("label")
        ),
    )


@_query
def day_type(t: TradeTables) -> DataFrame:
    return t.payments().select("id", cal.day_type("payment_date").alias("label"))


@_query
def date_arithmetic(t: TradeTables) -> DataFrame:
    when = F.col("payment_date")
    return t.payments().select(
        "id",
        cal.shift(when, "HOUR", 1).alias("plus_hour"),
        cal.shift(when, "MINUTE", 15).alias("plus_quarter"),
        cal.shift(when, "DAY", -30).alias("minus_month"),
        cal.at_time(when, F.col("id") % 24, F.col("id") % 60).alias("at_time"),
        F.date_add(F.to_date(when), (F.col("id") % 7).cast("int")).alias("plus_days"),
    )


@_query
def string_functions(t: TradeTables) -> DataFrame:
    """E-mail from name parts and digits, as sign-ups build it."""
    first, last = F.split("c_name", "#")[0], F.split("c_name", "#")[1]
    digits = F.floor(F.abs("c_acctbal") % 10000).cast("string")
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower(first), F.lit("."), F.lower(last), digits, F.lit("@example.com")).alias("email"),
        F.concat(first, F.lit(" "), last).alias("name"),
    )


@_query
def math_functions(t: TradeTables) -> DataFrame:
    part = F.col("l_quantity").cast("bigint")
    whole = (F.col("l_quantity") + F.col("l_linenumber")).cast("bigint")
    return t.lineitem.select(
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        num.percent_of(part, whole).alias("pct"),
        F.floor(F.col("l_extendedprice") / 7).alias("floored"),
        num.guarded_ratio(
            F.col("l_extendedprice"), F.col("l_linenumber").cast("double") - F.lit(1.0)
        ).alias("ratio"),
    )


@_query
def array_functions(t: TradeTables) -> DataFrame:
    """Seat arrays of requests: length, first and last seat, one row per seat."""
    ids = F.col("seats.id")
    return t.booking_requests().select(
        "request_id",
        F.size(ids).alias("seat_count"),
        F.array_min(ids).alias("lowest"),
        F.array_max(ids).alias("highest"),
        F.explode(ids).alias("seat_id"),
    )


@_query
def json_functions(t: TradeTables) -> DataFrame:
    """A field read out of JSON text, and a document built from columns."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    document = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("label")))
    return t.events.select("event_id", k.alias("k"), document.alias("document"))


@_query
def json_first_showtime(t: TradeTables) -> DataFrame:
    """First showtime of every schedule document."""
    entries = seating.schedule(t.booking_model(), SHOW_DATE)
    return entries.select("id", docs.first_showtime_id("showtimes").alias("showtime_id"))


@_query
def json_first_available(t: TradeTables) -> DataFrame:
    """First free seat of every showtime's seat list document; a list is one auditorium long."""
    seat = F.struct("row_code", "number", F.col("seat_id").alias("id"), "status")
    lists = seating.seat_map(t.booking_model()).groupBy("showtime_id").agg(
        F.to_json(F.array_sort(F.collect_list(seat))).alias("document")
    )
    return lists.select("showtime_id", docs.first_available_seat("document").alias("seat_id"))


@_query
def fmt_currency(t: TradeTables) -> DataFrame:
    third = (F.col("amount") * F.lit("0.3333").cast("decimal(5,4)")).cast("decimal(18,6)")
    return t.payments().select(
        "id",
        num.fmt_currency("amount").alias("amount_label"),
        num.fmt_currency(third).alias("third_label"),
        num.fmt_currency(F.when(F.col("id") % 2 == 0, F.col("amount"))).alias("nullable_label"),
    )


@_query
def fmt_axis(t: TradeTables) -> DataFrame:
    scaled = F.col("amount") * F.element_at(
        F.array(F.lit("0.001"), F.lit("1"), F.lit("10")).cast("array<decimal(6,3)>"),
        (F.col("id") % 3 + 1).cast("int"),
    )
    return t.payments().select("id", num.fmt_axis(scaled).alias("label"))


@_query
def fmt_date_labels(t: TradeTables) -> DataFrame:
    return t.payments().select(
        "id",
        cal.short_date("payment_date").alias("short_label"),
        cal.long_date("payment_date").alias("long_label"),
        cal.weekday_date("payment_date").alias("weekday_label"),
    )


@_query
def parse_numbers(t: TradeTables) -> DataFrame:
    """Texts that start with a number, and texts that are empty on every fifth row."""
    text = F.concat(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit(" PHP"))
    sometimes = F.when(F.col("o_orderkey") % 5 != 0, text).otherwise("")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        num.parse_float(text).alias("price"),
        num.parse_float(sometimes).alias("price_or_zero"),
        num.parse_int("o_orderpriority").alias("priority"),
        num.parse_int(sometimes).alias("whole_or_zero"),
        num.parse_int("o_orderstatus").alias("no_number"),
    )


@_query
def seat_grid_column(t: TradeTables) -> DataFrame:
    return t.seats().select("id", "number", num.seat_grid_column("number").alias("grid_column"))


# -- request log --------------------------------------------------------------------------

_each(
    TradeTables.request_log, latency.latency_summary, latency.sla_check, latency.slowest_labels)
