"""Explicit schemas of all tables; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
LONG, INT, STR, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
TS, DATE, DOUBLE = T.TimestampNTZType(), T.DateType(), T.DoubleType()


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


OPERATIONAL = {
    "customers": _table(("id", LONG), ("email", STR), ("name", STR)),
    "movies": _table(("id", LONG), ("title", STR), ("duration_minutes", INT), ("price", MONEY)),
    "auditoriums": _table(("id", LONG), ("name", STR), ("total_seats", INT)),
    "showtimes": _table(
        ("id", LONG), ("movie_id", LONG), ("auditorium_id", LONG), ("start_time", TS)
    ),
    "seats": _table(("id", LONG), ("auditorium_id", LONG), ("row_code", STR), ("number", INT)),
    "reservation_holds": _table(
        ("id", LONG),
        ("showtime_id", LONG),
        ("seat_id", LONG),
        ("customer_id", LONG),
        ("hold_expires_at", TS),
        ("status", STR),
    ),
    "payments": _table(
        ("id", LONG),
        ("customer_id", LONG),
        ("amount", MONEY),
        ("payment_date", TS),
        ("payment_method", STR),
    ),
    "tickets": _table(
        ("id", LONG), ("reservation_id", LONG), ("payment_id", LONG), ("price", MONEY)
    ),
}

FACT_BOOKINGS = _table(
    ("id", LONG),
    ("booking_date", DATE),
    ("booking_time", STR),
    ("booking_timestamp", TS),
    ("movie_id", LONG),
    ("movie_title", STR),
    ("movie_duration", INT),
    ("movie_price", MONEY),
    ("showtime_id", LONG),
    ("showtime_start", TS),
    ("auditorium_id", LONG),
    ("auditorium_name", STR),
    ("customer_id", LONG),
    ("customer_email", STR),
    ("customer_name", STR),
    ("seats_booked", INT),
    ("total_revenue", MONEY),
    ("payment_method", STR),
    ("day_of_week", STR),
    ("week_of_year", INT),
    ("month_num", INT),
    ("month_name", STR),
    ("year", INT),
    ("quarter", INT),
    ("is_weekend", BOOL),
    ("time_of_day", STR),
)

#: Columns that partition the fact and what is kept by month.
MONTH = "year int, month_num int"

DIM_MOVIES = _table(
    ("movie_id", LONG),
    ("title", STR),
    ("duration_minutes", INT),
    ("base_price", MONEY),
    ("genre", STR),
    ("last_updated", TS),
)

DIM_TIME = _table(
    ("date", DATE),
    ("day_of_week", STR),
    ("day_of_month", INT),
    ("week_of_year", INT),
    ("month_num", INT),
    ("month_name", STR),
    ("quarter", INT),
    ("year", INT),
    ("is_weekend", BOOL),
    ("is_holiday", BOOL),
)

# Trade tables the booking model can be derived from.
TRADE = {
    "customer": _table(
        ("c_custkey", LONG),
        ("c_name", STR),
        ("c_nationkey", INT),
        ("c_acctbal", DOUBLE),
        ("c_mktsegment", STR),
    ),
    "supplier": _table(
        ("s_suppkey", LONG), ("s_name", STR), ("s_nationkey", INT), ("s_acctbal", DOUBLE)
    ),
    "part": _table(
        ("p_partkey", LONG),
        ("p_name", STR),
        ("p_brand", STR),
        ("p_type", STR),
        ("p_size", INT),
        ("p_retailprice", DOUBLE),
    ),
    "orders": _table(
        ("o_orderkey", LONG),
        ("o_custkey", LONG),
        ("o_orderstatus", STR),
        ("o_totalprice", DOUBLE),
        ("o_orderdate", TS),
        ("o_orderpriority", STR),
    ),
    "lineitem": _table(
        ("l_orderkey", LONG),
        ("l_partkey", LONG),
        ("l_suppkey", LONG),
        ("l_linenumber", INT),
        ("l_quantity", DOUBLE),
        ("l_extendedprice", DOUBLE),
        ("l_discount", DOUBLE),
        ("l_tax", DOUBLE),
        ("l_returnflag", STR),
        ("l_linestatus", STR),
        ("l_shipdate", TS),
    ),
    "events": _table(
        ("event_id", LONG),
        ("ts", TS),
        ("user_id", LONG),
        ("event_type", STR),
        ("value", DOUBLE),
        ("props", STR),
    ),
}

# What a change feed adds to a row: INSERT, UPDATE or DELETE, and a number that grows with time.
CHANGE = _table(("change_kind", STR), ("change_version", LONG))

SEAT_CHOICE = T.ArrayType(_table(("id", LONG), ("price", MONEY)))

BOOKING_REQUESTS = _table(
    ("request_id", LONG),
    ("requested_at", TS),
    ("showtime_id", LONG),
    ("seats", SEAT_CHOICE),
    ("customer_name", STR),
    ("customer_email", STR),
    ("payment_method", STR),
    ("payment_amount", MONEY),
)

REQUEST_LOG = _table(
    ("timeStamp", LONG),
    ("elapsed", LONG),
    ("label", STR),
    ("responseCode", STR),
    ("responseMessage", STR),
    ("threadName", STR),
    ("dataType", STR),
    ("success", BOOL),
    ("failureMessage", STR),
    ("bytes", LONG),
    ("sentBytes", LONG),
    ("grpThreads", INT),
    ("allThreads", INT),
    ("URL", STR),
    ("Latency", LONG),
    ("IdleTime", LONG),
    ("Connect", LONG),
)

# Columns every report over a log needs.
REQUEST_LOG_NEEDED = ["timeStamp", "elapsed", "label", "success"]

PRIMARY_KEYS = {name: ["id"] for name in OPERATIONAL}

UNIQUE_KEYS = [
    *[(table, keys) for table, keys in PRIMARY_KEYS.items()],
    ("customers", ["email"]),
    ("seats", ["auditorium_id", "row_code", "number"]),
    ("reservation_holds", ["showtime_id", "seat_id"]),
]

NOT_NULL = {
    "customers": ["id", "email"],
    "movies": ["id", "title", "price"],
    "auditoriums": ["id"],
    "showtimes": ["id", "start_time"],
    "seats": ["id"],
    "reservation_holds": ["id", "hold_expires_at"],
    # payment_date may be null in the source, but every fact row needs one
    "payments": ["id", "amount", "payment_date"],
    "tickets": ["id"],
}

FACT_NOT_NULL = [
    "booking_date",
    "booking_time",
    "movie_id",
    "movie_title",
    "showtime_id",
    "showtime_start",
    "auditorium_id",
    "customer_id",
    "total_revenue",
]

FOREIGN_KEYS = [
    ("showtimes", "movie_id", "movies"),
    ("showtimes", "auditorium_id", "auditoriums"),
    ("seats", "auditorium_id", "auditoriums"),
    ("reservation_holds", "showtime_id", "showtimes"),
    ("reservation_holds", "seat_id", "seats"),
    ("reservation_holds", "customer_id", "customers"),
    ("payments", "customer_id", "customers"),
    ("tickets", "reservation_id", "reservation_holds"),
    ("tickets", "payment_id", "payments"),
]

# Length limits of the text columns.
TEXT_LIMITS = {
    "customers": {"email": 255, "name": 255},
    "movies": {"title": 255},
    "auditoriums": {"name": 50},
    "seats": {"row_code": 1},
    "reservation_holds": {"status": 20},
    "payments": {"payment_method": 50},
}

# Column defaults.
HOLD_DEFAULTS = {"status": "CONFIRMED"}
PAYMENT_DEFAULTS = {"payment_method": "CREDIT_CARD"}
FACT_DEFAULTS = {"seats_booked": 1, "payment_method": "CREDIT_CARD"}
DIM_TIME_DEFAULTS = {"is_holiday": False}
