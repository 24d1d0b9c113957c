"""The booking model derived from the trade tables (orders, lineitem, part, ...).

Every derivation reads its tables whole. Ten consecutive parts make one movie with ten
showtimes, every supplier is an auditorium, every order is a payment and every line of it one
held and ticketed seat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .generators import SEATS_PER_ROW, build_seats
from .schemas import OPERATIONAL, TRADE
from .snapshots import Model

SEATS_PER_AUDITORIUM = 200
# Ids kept free for the lines of one order.
LINES_PER_ORDER = 1000

PAYMENT_TIME = """timestampadd(MINUTE, (o_orderkey * 13) % 60,
                               timestampadd(HOUR, (o_orderkey * 7) % 24, o_orderdate))"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TRADE[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class _DerivedModel(dict):
    """The eight tables, each derived when first asked for."""

    def __init__(self, tables: TradeTables):
        super().__init__()
        self._tables = tables

    def __contains__(self, name: object) -> bool:
        return name in OPERATIONAL

    def __missing__(self, name: str) -> DataFrame:
        self[name] = getattr(self._tables, name)()
        return self[name]


class TradeTables:
    """Lazy views over one folder of trade tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TRADE:
            raise AttributeError(name)
        table = read_table(self.spark, self.sf_dir, name)
        setattr(self, name, table)
        return table

    def lines(self) -> DataFrame:
        """Every order line with its place in the order, its showtime and its seat there.

        Lines that agree in number, part and price are interchangeable.
        What follows from an order's key is added after the places are known: holds and tickets
        then shuffle the same columns, and share one shuffle.
        """
        return self.spark.sql(
            f"""
            SELECT l_orderkey, l_linenumber, place, showtime_id, price,
                   showtime_id % (SELECT count(*) FROM {{supplier}}) * {SEATS_PER_AUDITORIUM}L
                     + l_partkey % {SEATS_PER_AUDITORIUM}L AS seat_id
            FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
                         l_orderkey % (SELECT count(*) FROM {{part}}) AS showtime_id
                  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                                       ORDER BY l_linenumber, l_partkey, l_extendedprice) AS place
                        FROM {{lineitem}}))
            """,
            lineitem=self.lineitem,
            part=self.part,
            supplier=self.supplier,
        )

    # -- tables -------------------------------------------------------------------------

    def customers(self) -> DataFrame:
        return self.customer.selectExpr(
            "c_custkey AS id", "lower(c_name) || '@example.com' AS email", "c_name AS name"
        )

    def movies(self) -> DataFrame:
        return self.spark.sql(
            """
            SELECT id, lead.p_name AS title, 60 + lead.p_size AS duration_minutes,
                   CAST(lead.p_retailprice AS DECIMAL(10,2)) AS price
            FROM (SELECT p_partkey - p_partkey % 10 AS id,
                         min_by(struct(p_name, p_size, p_retailprice), p_partkey) AS lead
                  FROM {part} GROUP BY 1)
            """,
            part=self.part,
        )

    def auditoriums(self) -> DataFrame:
        return self.supplier.selectExpr(
            "s_suppkey AS id",
            "'Cinema ' || s_suppkey AS name",
            f"{SEATS_PER_AUDITORIUM} AS total_seats",
        )

    def showtimes(self) -> DataFrame:
        return self.spark.sql(
            """
            SELECT p_partkey AS id, p_partkey - p_partkey % 10 AS movie_id,
                   p_partkey % (SELECT count(*) FROM {supplier}) AS auditorium_id,
                   timestampadd(MINUTE, p_partkey % 2 * 30, timestampadd(HOUR, 10 + p_partkey % 12,
                     timestampadd(DAY, p_partkey % 7, TIMESTAMP_NTZ '2024-01-01'))) AS start_time
            FROM {part}
            """,
            part=self.part,
            supplier=self.supplier,
        )

    def seats(self) -> DataFrame:
        return build_seats(self.auditoriums()).selectExpr(
            f"""auditorium_id * {SEATS_PER_AUDITORIUM}
                + (ascii(row_code) - ascii('A')) * {SEATS_PER_ROW} + number - 1 AS id""",
            "auditorium_id",
            "row_code",
            "number",
        )

    def payments(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_orderkey AS id",
            "o_custkey AS customer_id",
            "CAST(o_totalprice AS DECIMAL(10,2)) AS amount",
            f"{PAYMENT_TIME} AS payment_date",
            """CASE WHEN o_orderkey % 20 < 12 THEN 'CREDIT_CARD'
                    WHEN o_orderkey % 20 < 17 THEN 'DEBIT_CARD'
                    WHEN o_orderkey % 20 < 19 THEN 'GCASH' ELSE 'CASH' END AS payment_method""",
        )

    def reservation_holds(self) -> DataFrame:
        return self.spark.sql(
            f"""
            SELECT l_orderkey * {LINES_PER_ORDER}L + place AS id, showtime_id, seat_id,
                   o_custkey AS customer_id,
                   timestampadd(MINUTE, 15, {PAYMENT_TIME}) AS hold_expires_at,
                   CASE l_linenumber % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'HELD'
                        ELSE 'BOOKED' END AS status
            FROM {{lines}} JOIN {{orders}} ON o_orderkey = l_orderkey
            """,
            lines=self.lines(),
            orders=self.orders,
        )

    def tickets(self) -> DataFrame:
        return self.lines().selectExpr(
            f"l_orderkey * {LINES_PER_ORDER}L + place AS id",
            f"l_orderkey * {LINES_PER_ORDER}L + place AS reservation_id",
            "l_orderkey AS payment_id",
            "price",
        )

    def booking_model(self) -> Model:
        return _DerivedModel(self)

    # -- logs ---------------------------------------------------------------------------

    def booking_requests(self) -> DataFrame:
        """One request per order with lines; its body holds one seat per line.

        Payments meet their customers first, so that no array of lines is shuffled.
        """
        return self.spark.sql(
            """
            SELECT request_id, payment_date AS requested_at, showtime_id,
                   transform(lines, x -> struct(x.id AS id, x.price AS price)) AS seats,
                   name AS customer_name, email AS customer_email, payment_method,
                   amount AS payment_amount
            FROM (SELECT l_orderkey AS request_id, showtime_id,
                         array_sort(collect_list(struct(place, seat_id AS id, price))) AS lines
                  FROM {lines} GROUP BY l_orderkey, showtime_id)
            JOIN (SELECT p.*, name, email FROM {payments} p JOIN {customers} c ON c.id = customer_id) paid
              ON paid.id = request_id
            """,
            lines=self.lines(),
            payments=self.payments(),
            customers=self.customers(),
        )

    def request_log(self) -> DataFrame:
        """Events read as a request log: one sample per event."""
        return self.events.selectExpr(
            "unix_micros(CAST(ts AS TIMESTAMP)) / 1000.0D AS started_ms",
            "value AS elapsed_ms",
            "event_type AS label",
            "event_type <> 'error' AS success",
        )
