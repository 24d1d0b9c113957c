"""DuckDB SQL for the registered queries, written independently of the Spark code."""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"
HOLDS_AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"

# The labels of an hour, by the rule of the fact load and by the half-open rule.
ETL_LABEL = """CASE WHEN {0} BETWEEN 0 AND 5 THEN 'Late Night' WHEN {0} BETWEEN 6 AND 11 THEN 'Morning'
              WHEN {0} BETWEEN 12 AND 17 THEN 'Afternoon' WHEN {0} BETWEEN 18 AND 21 THEN 'Evening'
              ELSE 'Night' END"""
FN_LABEL = """CASE WHEN {0} >= 6 AND {0} < 12 THEN 'Morning' WHEN {0} >= 12 AND {0} < 17 THEN 'Afternoon'
              WHEN {0} >= 17 AND {0} < 21 THEN 'Evening' ELSE 'Night' END"""

MODEL = """
WITH RECURSIVE
counts AS (SELECT (SELECT count(*) FROM part) AS np, (SELECT count(*) FROM supplier) AS ns),
customers AS (
  SELECT c_custkey AS id, lower(c_name) || '@example.com' AS email, c_name AS name FROM customer),
movies AS (
  SELECT p_partkey - p_partkey % 10 AS id, arg_min(p_name, p_partkey) AS title,
         60 + arg_min(p_size, p_partkey) AS duration_minutes,
         CAST(arg_min(p_retailprice, p_partkey) AS DECIMAL(10,2)) AS price
  FROM part GROUP BY 1),
auditoriums AS (SELECT s_suppkey AS id, 'Cinema ' || s_suppkey AS name, 200 AS total_seats FROM supplier),
showtimes AS (
  SELECT p_partkey AS id, p_partkey - p_partkey % 10 AS movie_id, p_partkey % ns AS auditorium_id,
         TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (p_partkey % 7)
           + INTERVAL 1 HOUR * (10 + p_partkey % 12) + INTERVAL 1 MINUTE * (p_partkey % 2 * 30) AS start_time
  FROM part, counts),
seats AS (
  SELECT a.id * 200 + r.r * 20 + n.n - 1 AS id, a.id AS auditorium_id,
         substr('ABCDEFGHIJ', CAST(r.r + 1 AS BIGINT), 1) AS row_code, CAST(n.n AS INTEGER) AS number
  FROM auditoriums a, range(10) r(r), range(1, 21) n(n)),
payments AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
         o_orderdate + INTERVAL 1 HOUR * ((o_orderkey * 7) % 24)
           + INTERVAL 1 MINUTE * ((o_orderkey * 13) % 60) AS payment_date,
         CASE WHEN o_orderkey % 20 < 12 THEN 'CREDIT_CARD' WHEN o_orderkey % 20 < 17 THEN 'DEBIT_CARD'
              WHEN o_orderkey % 20 < 19 THEN 'GCASH' ELSE 'CASH' END AS payment_method
  FROM orders),
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS pk, l_extendedprice AS px,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber, l_partkey, l_extendedprice) AS place
  FROM lineitem),
reservation_holds AS (
  SELECT l_orderkey * 1000 + place AS id, l_orderkey % np AS showtime_id,
         (l_orderkey % np) % ns * 200 + pk % 200 AS seat_id, p.customer_id,
         p.payment_date + INTERVAL 15 MINUTE AS hold_expires_at,
         CASE l_linenumber % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'HELD' ELSE 'BOOKED' END AS status
  FROM lines JOIN payments p ON p.id = l_orderkey, counts),
tickets AS (
  SELECT l_orderkey * 1000 + place AS id, l_orderkey * 1000 + place AS reservation_id,
         l_orderkey AS payment_id, CAST(px AS DECIMAL(10,2)) AS price
  FROM lines),
request_seats AS (
  SELECT l_orderkey AS request_id, p.payment_date AS requested_at, l_orderkey % np AS showtime_id,
         (l_orderkey % np) % ns * 200 + pk % 200 AS seat_id, CAST(px AS DECIMAL(10,2)) AS price,
         CAST(place - 1 AS INTEGER) AS position,
         c.name AS customer_name, c.email AS customer_email, p.payment_method, p.amount AS payment_amount
  FROM lines JOIN payments p ON p.id = l_orderkey JOIN customers c ON c.id = p.customer_id, counts),
booking_lines AS (
  SELECT p.id AS payment_id, p.customer_id, p.amount, p.payment_date, p.payment_method, c.email,
         c.name AS customer_name, t.id AS ticket_id, t.reservation_id, h.showtime_id, s.start_time,
         s.movie_id, s.auditorium_id, m.title, m.duration_minutes, m.price, a.name AS auditorium_name
  FROM payments p JOIN customers c ON c.id = p.customer_id JOIN tickets t ON t.payment_id = p.id
  JOIN reservation_holds h ON h.id = t.reservation_id JOIN showtimes s ON s.id = h.showtime_id
  JOIN movies m ON m.id = s.movie_id JOIN auditoriums a ON a.id = s.auditorium_id),
fact AS (
  SELECT CAST(payment_date AS DATE) AS booking_date, strftime(payment_date, '%H:%M:%S') AS booking_time,
         payment_date AS booking_timestamp, movie_id, title AS movie_title,
         duration_minutes AS movie_duration, price AS movie_price, showtime_id,
         start_time AS showtime_start, auditorium_id, auditorium_name, customer_id,
         email AS customer_email, customer_name, CAST(count(ticket_id) AS INTEGER) AS seats_booked,
         amount AS total_revenue, payment_method, dayname(payment_date) AS day_of_week,
         CAST(weekofyear(payment_date) AS INTEGER) AS week_of_year,
         CAST(month(payment_date) AS INTEGER) AS month_num, monthname(payment_date) AS month_name,
         CAST(year(payment_date) AS INTEGER) AS year, CAST(quarter(payment_date) AS INTEGER) AS quarter,
         dayofweek(payment_date) IN (0, 6) AS is_weekend,
         ETL_LABEL_OF_PAYMENT AS time_of_day
  FROM booking_lines
  GROUP BY payment_date, movie_id, title, duration_minutes, price, showtime_id, start_time,
           auditorium_id, auditorium_name, customer_id, email, customer_name, amount, payment_method)
""".replace("ETL_LABEL_OF_PAYMENT", ETL_LABEL.format("hour(payment_date)"))


def _queue(taken: str, valid: str = "true") -> str:
    """Requests served one after another per showtime; ``taken`` lists the slots gone before."""
    return f""",
gone AS ({taken}),
requests AS (
  SELECT request_id, showtime_id, any_value(requested_at) AS requested_at,
         list(seat_id ORDER BY position) AS seat_ids
  FROM request_seats WHERE {valid} GROUP BY 1, 2),
queue AS (
  SELECT *, row_number() OVER (PARTITION BY showtime_id ORDER BY requested_at, request_id) AS turn
  FROM requests),
served AS (
  SELECT q.showtime_id, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS request_id,
         CAST(NULL AS BIGINT) AS rejected_seat,
         coalesce(any_value(g.seat_ids), CAST([] AS BIGINT[])) AS taken
  FROM queue q LEFT JOIN gone g ON g.showtime_id = q.showtime_id GROUP BY 1
  UNION ALL
  SELECT showtime_id, turn, request_id, conflicts[1],
         CASE WHEN len(conflicts) = 0 THEN list_concat(taken, seat_ids) ELSE taken END
  FROM (SELECT q.showtime_id, q.turn, q.request_id, q.seat_ids, s.taken,
               list_filter(q.seat_ids, lambda x, i: list_contains(s.taken, x)
                                                    OR list_position(q.seat_ids, x) < i) AS conflicts
        FROM served s JOIN queue q ON q.showtime_id = s.showtime_id AND q.turn = s.turn + 1)),
decisions AS (
  SELECT request_id, rejected_seat IS NULL AS accepted, rejected_seat,
         CASE WHEN rejected_seat IS NOT NULL THEN 'SEAT_TAKEN' END AS reason
  FROM served WHERE turn > 0)
"""


NO_HOLDS = "SELECT CAST(NULL AS BIGINT) AS showtime_id, CAST([] AS BIGINT[]) AS seat_ids WHERE false"
ALL_HOLDS = """SELECT showtime_id, list(DISTINCT seat_id) AS seat_ids
               FROM reservation_holds GROUP BY showtime_id"""
ACTIVE = f"status = 'BOOKED' OR (status = 'HELD' AND hold_expires_at > {HOLDS_AS_OF})"
ACTIVE_HOLDS = f"""SELECT showtime_id, list(DISTINCT seat_id) AS seat_ids
                   FROM reservation_holds WHERE {ACTIVE} GROUP BY showtime_id"""

MONEY = "CAST(sum({0}) AS DECIMAL(20,2))"
AVG_MONEY = "CAST(sum(total_revenue) AS DOUBLE) / count(*)"
REVENUE = MONEY.format("total_revenue")
SEATS = "CAST(sum(seats_booked) AS BIGINT)"
SHARE = """CAST((bookings * 2000 + total) // (2 * total) AS DOUBLE) / 10.0 AS pct
           FROM (SELECT *, CAST(sum(bookings) OVER () AS BIGINT) AS total FROM g)"""

TIME_TOTALS = f""", totals AS (
  SELECT time_of_day, count(*) AS booking_count, {REVENUE} AS revenue FROM fact GROUP BY 1),
ranked AS (
  SELECT *, CAST(coalesce(list_position(['Morning', 'Afternoon', 'Evening', 'Night', 'Late Night'],
                                        time_of_day), 0) - 1 AS INTEGER) AS sort_rank FROM totals)
"""

TOP_MOVIES = f"""
SELECT movie_title, {REVENUE} AS total_revenue, {SEATS} AS total_seats,
       count(DISTINCT booking_date) AS days_shown, {AVG_MONEY} AS avg_revenue_per_booking
FROM fact GROUP BY movie_title ORDER BY total_revenue DESC, movie_title LIMIT 10
"""


def _slots(revenue: str, seats: str) -> str:
    return f"""SELECT time_of_day, day_of_week, count(*) AS booking_count, {REVENUE} AS {revenue},
                      avg(seats_booked) AS {seats} FROM fact GROUP BY 1, 2"""


def _hash(*keys: str) -> str:
    joined = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"


PAIRS = """, pairs AS (
  SELECT sh.id AS showtime_id, s.id AS seat_id, s.row_code, s.number,
         EXISTS (SELECT 1 FROM reservation_holds h WHERE h.seat_id = s.id AND h.showtime_id = sh.id) AS taken
  FROM seats s JOIN auditoriums a ON a.id = s.auditorium_id JOIN showtimes sh ON sh.auditorium_id = a.id)
"""

HOUR = "hour(payment_date)"
SLOT4 = f"""CASE WHEN {HOUR} BETWEEN 6 AND 11 THEN 'Morning' WHEN {HOUR} BETWEEN 12 AND 17 THEN 'Afternoon'
                 WHEN {HOUR} BETWEEN 18 AND 21 THEN 'Evening' ELSE 'Night' END"""
DAY_TYPE = """CASE WHEN dayofweek(payment_date) IN (0, 6) THEN 'Weekend'
                   WHEN dayofweek(payment_date) = 5 THEN 'Friday' ELSE 'Weekday' END"""


def _label(expression: str) -> str:
    return f"SELECT id, {expression} AS label FROM payments"


def _per_column(checks: dict[str, list[str]], test: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column.split()[0]}' AS column_name, "
        f"count(*) FILTER ({test.format(*column.split())}) AS violations FROM {table}"
        for table, columns in checks.items()
        for column in columns
    )


NULL_CHECKS = {
    "customers": ["id", "email"],
    "movies": ["id", "title", "price"],
    "auditoriums": ["id"],
    "showtimes": ["id", "start_time"],
    "seats": ["id"],
    "reservation_holds": ["id", "hold_expires_at"],
    "payments": ["id", "amount", "payment_date"],
    "tickets": ["id"],
}
LENGTH_CHECKS = {
    "customers": ["email 255", "name 255"],
    "movies": ["title 255"],
    "auditoriums": ["name 50"],
    "seats": ["row_code 1"],
    "reservation_holds": ["status 20"],
    "payments": ["payment_method 50"],
}
KEY_CHECKS = [
    *((table, "id") for table in NULL_CHECKS),
    ("customers", "email"),
    ("seats", "auditorium_id,row_code,number"),
    ("reservation_holds", "showtime_id,seat_id"),
]
REFERENCES = [
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


def _currency(amount: str) -> str:
    cents = f"CAST(round(coalesce({amount}, 0), 3) * 1000 AS BIGINT)"
    return f"""'₱' || format('{{:,}}', {cents} // 1000) || '.'
               || regexp_replace(lpad(CAST({cents} % 1000 AS VARCHAR), 3, '0'), '0$', '')"""


LATENCY = """
samples AS (
  SELECT unnest([event_type, 'TOTAL']) AS label, epoch_us(ts) / 1000.0 AS started, value AS elapsed,
         event_type = 'error' AS failed FROM events),
latency AS (
  SELECT label, count(*) AS samples, round(avg(elapsed), 6) AS avg_ms, min(elapsed) AS min_ms,
         max(elapsed) AS max_ms, round(quantile_cont(elapsed, 0.9), 6) AS p90_ms,
         round(quantile_cont(elapsed, 0.95), 6) AS p95_ms,
         round(CAST(count(*) FILTER (failed) AS DOUBLE) / count(*), 6) AS error_rate,
         round(count(*) / ((max(started + elapsed) - min(started)) / 1000.0), 6) AS throughput_per_s
  FROM samples GROUP BY label)
"""

SQL = {
    "fact_bookings": "SELECT * FROM fact",
    "daily_revenue": f"""
        SELECT booking_date, {REVENUE} AS daily_revenue, count(*) AS bookings, {SEATS} AS seats_sold
        FROM fact WHERE booking_date >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1""",
    "analytics_summary": f"""
        SELECT count(DISTINCT customer_id) AS total_customers, count(*) AS total_bookings,
               {SEATS} AS total_seats_sold, {REVENUE} AS total_revenue, {AVG_MONEY} AS avg_booking_value
        FROM fact""",
    "top_movies": TOP_MOVIES,
    "timeslots": _slots("revenue", "avg_seats"),
    "mv_daily_revenue": f"""
        SELECT booking_date, movie_title, auditorium_name, {REVENUE} AS total_revenue,
               {SEATS} AS total_seats, count(*) AS total_bookings, {AVG_MONEY} AS avg_transaction_value
        FROM fact GROUP BY 1, 2, 3""",
    "mv_movie_performance": f"""
        SELECT movie_title, count(DISTINCT booking_date) AS days_shown, {SEATS} AS total_seats_sold,
               {REVENUE} AS total_revenue, avg(seats_booked) AS avg_seats_per_booking,
               count(DISTINCT showtime_id) AS total_showtimes
        FROM fact GROUP BY 1""",
    "mv_timeslot_analysis": _slots("total_revenue", "avg_seats_per_booking"),
    "etl_summary": f"""
        SELECT count(*) AS total_fact_records, {SEATS} AS total_seats, {REVENUE} AS total_revenue,
               min(booking_date) AS earliest_booking, max(booking_date) AS latest_booking,
               count(DISTINCT customer_id) AS unique_customers, count(DISTINCT movie_id) AS unique_movies
        FROM fact""",
    "booking_distribution": f"""
        SELECT booking_date AS date, count(*) AS bookings, {REVENUE} AS revenue
        FROM fact GROUP BY 1 ORDER BY 1 DESC LIMIT 10""",
    "time_of_day_totals": (TIME_TOTALS, "SELECT * FROM totals"),
    "time_of_day_ordered": (TIME_TOTALS, "SELECT * FROM ranked"),
    "movies_pct_of_max": (
        f", best AS ({TOP_MOVIES})",
        """SELECT CAST(row_number() OVER (ORDER BY total_revenue DESC, movie_title) - 1 AS INTEGER) AS rank,
                  movie_title, total_revenue, total_seats,
                  CAST(total_revenue AS DOUBLE) / max(CAST(total_revenue AS DOUBLE)) OVER () * 100
                    AS pct_of_max FROM best""",
    ),
    "slots_pct_of_max": (
        TIME_TOTALS,
        """SELECT *, CAST(booking_count AS DOUBLE) / CAST(max(booking_count) OVER () AS DOUBLE) * 100
                    AS value FROM ranked""",
    ),
    "booking_stats": f"""
        SELECT count(*) AS bookings, count(DISTINCT customer_id) AS customers,
               {MONEY.format("amount")} AS revenue FROM payments""",
    "seats_per_booking": (
        """, g AS (SELECT seat_count, count(*) AS bookings
                   FROM (SELECT payment_id, count(*) AS seat_count FROM tickets GROUP BY 1) GROUP BY 1)""",
        f"SELECT seat_count, bookings, {SHARE}",
    ),
    "slot_distribution": (
        f", g AS (SELECT {SLOT4} AS slot, count(*) AS bookings FROM payments GROUP BY 1)",
        f"SELECT slot, bookings, {SHARE}",
    ),
    "day_type_distribution": (
        f", g AS (SELECT {DAY_TYPE} AS type, count(*) AS bookings FROM payments GROUP BY 1)",
        f"SELECT type, bookings, {SHARE}",
    ),
    "repeat_rate": """
        SELECT total, repeats, CAST((repeats * 2000 + total) // (2 * nullif(total, 0)) AS DOUBLE) / 10.0 AS pct
        FROM (SELECT count(DISTINCT customer_id) AS total,
                     count(DISTINCT CASE WHEN b > 1 THEN customer_id END) AS repeats
              FROM (SELECT customer_id, count(*) AS b FROM payments GROUP BY 1))""",
    "booking_lines": "SELECT * FROM booking_lines",
    "integrity_not_null": _per_column(NULL_CHECKS, "WHERE {0} IS NULL"),
    "integrity_fact_not_null": """
        SELECT 'fact_bookings' AS table_name, c.name AS column_name, count(*) - any_value(c.n) AS violations
        FROM fact, (
          SELECT unnest(['booking_date', 'booking_time', 'movie_id', 'movie_title', 'showtime_id',
                         'showtime_start', 'auditorium_id', 'customer_id', 'total_revenue']) AS name,
                 unnest([count(booking_date), count(booking_time), count(movie_id), count(movie_title),
                         count(showtime_id), count(showtime_start), count(auditorium_id),
                         count(customer_id), count(total_revenue)]) AS n FROM fact) c
        GROUP BY c.name""",
    "integrity_text_length": _per_column(LENGTH_CHECKS, "WHERE length({0}) > {1}"),
    "integrity_unique": " UNION ALL ".join(
        f"SELECT '{table}({keys})' AS constraint_name, concat_ws('|', {keys}) AS key_value, "
        f"count(*) AS copies FROM {table} GROUP BY {keys} HAVING count(*) > 1"
        for table, keys in KEY_CHECKS
    ),
    "integrity_foreign_keys": " UNION ALL ".join(
        f"SELECT '{table}.{column}->{parent}' AS constraint_name, count(*) AS orphans FROM {table} "
        f"WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {parent})"
        for table, column, parent in REFERENCES
    ),
    "payments_without_tickets": """
        SELECT * FROM payments WHERE id NOT IN (SELECT payment_id FROM tickets)""",
    "payment_amount_mismatch": f"""
        SELECT payment_id, any_value(amount) AS amount, {MONEY.format("t.price")} AS ticket_total,
               count(*) AS tickets
        FROM payments p JOIN tickets t ON t.payment_id = p.id GROUP BY payment_id
        HAVING any_value(amount) <> sum(t.price)""",
    "double_bookings": """
        SELECT showtime_id, seat_id, count(*) AS booking_count FROM reservation_holds
        GROUP BY 1, 2 HAVING count(*) > 1""",
    "recon_counts": """
        SELECT p AS source_count, f AS fact_count, p - f AS difference
        FROM (SELECT (SELECT count(*) FROM payments) AS p, (SELECT count(*) FROM fact) AS f)""",
    "recon_payments_vs_fact": f"""
        SELECT coalesce(s.day, f.day) AS day, coalesce(source_seats, 0) AS source_seats,
               coalesce(fact_seats, 0) AS fact_seats,
               CAST(coalesce(source_revenue, 0) AS DECIMAL(20,2)) AS source_revenue,
               CAST(coalesce(fact_revenue, 0) AS DECIMAL(20,2)) AS fact_revenue,
               CAST(coalesce(source_revenue, 0) - coalesce(fact_revenue, 0) AS DECIMAL(20,2)) AS revenue_gap
        FROM (SELECT CAST(payment_date AS DATE) AS day, {MONEY.format("amount")} AS source_revenue,
                     CAST(sum((SELECT count(*) FROM tickets t WHERE t.payment_id = p.id)) AS BIGINT)
                       AS source_seats
              FROM payments p GROUP BY 1) s
        FULL JOIN (SELECT booking_date AS day, {REVENUE} AS fact_revenue, {SEATS} AS fact_seats
                   FROM fact GROUP BY 1) f ON f.day = s.day""",
    "feed_freshness": """
        SELECT s AS newest_source, f AS newest_fact, date_diff('second', f, s) AS lag_seconds
        FROM (SELECT (SELECT max(payment_date) FROM payments) AS s,
                     (SELECT max(booking_timestamp) FROM fact) AS f)""",
    "seat_map": (
        PAIRS,
        """SELECT showtime_id, seat_id, row_code, number,
                  CASE WHEN taken THEN 'TAKEN' ELSE 'available' END AS status FROM pairs""",
    ),
    "available_seats": (
        PAIRS,
        "SELECT showtime_id, seat_id, row_code, number FROM pairs WHERE NOT taken",
    ),
    "available_seat_arrays": (
        PAIRS,
        """SELECT showtime_id, string_agg(CAST(seat_id AS VARCHAR), ',' ORDER BY seat_id) AS seat_ids,
                  CAST(count(*) AS INTEGER) AS seat_count FROM pairs WHERE NOT taken GROUP BY 1""",
    ),
    "seat_occupancy": (
        PAIRS,
        """SELECT showtime_id, count(*) AS total_seats, count(*) FILTER (taken) AS taken_seats,
                  count(*) FILTER (NOT taken) AS available_seats,
                  CAST(count(*) FILTER (taken) AS DOUBLE) / count(*) AS occupancy,
                  arg_min(row_code || number, ascii(row_code) * 100 + number) FILTER (NOT taken)
                    AS first_available
           FROM pairs GROUP BY 1""",
    ),
    "schedule": """
        SELECT m.id, m.title, m.price,
               '[' || string_agg('{"id":' || s.id || ',"time":"' || strftime(s.start_time, '%H:%M') || '"}',
                                 ',' ORDER BY s.start_time, s.id) || ']' AS showtimes
        FROM movies m JOIN showtimes s ON s.movie_id = m.id
        WHERE CAST(s.start_time AS DATE) = DATE '2024-01-03' GROUP BY 1, 2, 3""",
    "hold_status_counts": f"""
        SELECT showtime_id, count(*) AS total, count(*) FILTER ({ACTIVE}) AS active,
               count(*) FILTER (status = 'HELD' AND hold_expires_at > {HOLDS_AS_OF}) AS held,
               count(*) FILTER (status = 'HELD' AND hold_expires_at <= {HOLDS_AS_OF}) AS expired
        FROM reservation_holds GROUP BY 1""",
    "active_holds": f"SELECT * FROM reservation_holds WHERE {ACTIVE}",
    "slot_first_claim": """
        SELECT showtime_id, seat_id, request_id, requested_at FROM request_seats
        QUALIFY row_number() OVER (PARTITION BY showtime_id, seat_id
                                   ORDER BY requested_at, request_id) = 1""",
    "pick_available_seats": (
        PAIRS,
        f"""SELECT showtime_id, pick, seat_id FROM (
              SELECT showtime_id, seat_id, count(*) OVER (PARTITION BY showtime_id) AS n,
                     CAST(row_number() OVER (PARTITION BY showtime_id
                       ORDER BY {_hash("seat_id", "showtime_id", "7")}, seat_id) AS INTEGER) AS pick
              FROM pairs WHERE NOT taken) WHERE pick <= 3 AND n >= 3""",
    ),
    "weighted_pick": (
        f""", w AS (SELECT id, ln(1.0 + id / 2.0) AS log_w,
                           row_number() OVER (ORDER BY id DESC) - 1 AS rank FROM movies),
        edges AS (SELECT id, rank, exp(rank * log_w - (sum(log_w) OVER (ORDER BY rank) - log_w)) AS upper
                  FROM w),
        bands AS (SELECT *, coalesce(lead(upper) OVER (ORDER BY rank), 0.0) AS lower FROM edges),
        draws AS (SELECT id AS request_id, ({_hash("id", "7", "'band'")} + 0.5) / 4294967296.0 AS u,
                         {_hash("id", "7", "'winner'")} AS v FROM payments)""",
        """SELECT request_id, b2.id AS movie_id FROM draws JOIN bands b ON u > b.lower AND u <= b.upper
           JOIN bands b2 ON b2.rank = v % (b.rank + 1)""",
    ),
    "random_showtime_for_movie": (
        f""", numbered AS (
          SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY id % 64, id) - 1 AS position,
                 count(*) OVER (PARTITION BY movie_id) AS n FROM showtimes),
        wanted AS (SELECT DISTINCT request_id, s.movie_id, n,
                          {_hash("request_id", "7", "'showtime'")} AS v
                   FROM request_seats r JOIN numbered s ON s.id = r.showtime_id)""",
        """SELECT request_id, w.movie_id, s.id AS showtime_id, s.auditorium_id, m.price
           FROM wanted w JOIN numbered s ON s.movie_id = w.movie_id AND s.position = v % w.n
           JOIN movies m ON m.id = w.movie_id""",
    ),
    "explode_requests": """
        SELECT request_id, requested_at, showtime_id, position, seat_id, price FROM request_seats""",
    "admit_bookings": (_queue(NO_HOLDS), "SELECT * FROM decisions"),
    "admit_bookings_with_holds": (_queue(ACTIVE_HOLDS), "SELECT * FROM decisions"),
    "admit_bookings_invalid": (
        _queue(NO_HOLDS, "request_id % 11 > 0 AND request_id % 13 > 0 AND request_id % 17 > 0 AND request_id % 19 > 0"),
        """SELECT * FROM decisions UNION ALL
           SELECT DISTINCT request_id, false, CAST(NULL AS BIGINT),
                  CASE WHEN request_id % 11 = 0 THEN 'NO_EMAIL' WHEN request_id % 13 = 0 THEN 'NO_AMOUNT'
                       WHEN request_id % 17 = 0 THEN 'UNKNOWN_SHOWTIME' ELSE 'UNKNOWN_SEAT' END
           FROM request_seats
           WHERE request_id % 11 = 0 OR request_id % 13 = 0 OR request_id % 17 = 0 OR request_id % 19 = 0""",
    ),
    "released_holds": f"""
        SELECT showtime_id, seat_id, max(hold_expires_at) AS released_at FROM reservation_holds
        GROUP BY 1, 2 HAVING bool_and(status = 'HELD') AND max(hold_expires_at) <= {HOLDS_AS_OF}""",
    "seat_map_of": """
        SELECT s.id AS showtime_id, e.id AS seat_id, e.row_code, e.number,
               CASE WHEN EXISTS (SELECT 1 FROM reservation_holds h WHERE h.showtime_id = s.id AND h.seat_id = e.id)
                    THEN 'TAKEN' ELSE 'available' END AS status
        FROM showtimes s JOIN seats e ON e.auditorium_id = s.auditorium_id WHERE s.id = 7""",
    "fact_rebuilt_by_month": """
        SELECT year, month_num, count(*) AS fact_rows, count(*) AS ids, count(*) AS same_ids
        FROM fact GROUP BY 1, 2""",
    "hold_seats": (_queue(ALL_HOLDS), "SELECT * FROM decisions"),
    "hold_seats_reuse_expired": (
        _queue(ACTIVE_HOLDS),
        """SELECT r.request_id, r.showtime_id, r.seat_id, c.id AS customer_id,
                  r.requested_at + INTERVAL 5 MINUTE AS hold_expires_at, 'HELD' AS status
           FROM request_seats r JOIN customers c ON c.email = r.customer_email
           WHERE request_id IN (SELECT request_id FROM decisions WHERE accepted)""",
    ),
    "hold_seats_unpaid": (
        _queue(ACTIVE_HOLDS),
        """SELECT r.request_id, r.showtime_id, r.seat_id,
                  CASE WHEN r.request_id % 3 <> 0 THEN c.id END AS customer_id,
                  r.requested_at + INTERVAL 5 MINUTE AS hold_expires_at, 'HELD' AS status
           FROM request_seats r JOIN customers c ON c.email = r.customer_email
           WHERE request_id IN (SELECT request_id FROM decisions WHERE accepted)""",
    ),
    "fact_bookings_followed": "SELECT * FROM fact",
    "booking_outputs": (
        _queue(NO_HOLDS),
        """SELECT r.request_id, r.showtime_id, r.seat_id, r.requested_at + INTERVAL 1 HOUR AS hold_expires_at,
                  'CONFIRMED' AS status, r.price, r.payment_amount AS amount, r.requested_at AS payment_date,
                  r.payment_method, c.email, k.c_mktsegment <> 'AUTOMOBILE' AS is_new
           FROM request_seats r JOIN customers c ON c.email = r.customer_email
           JOIN customer k ON k.c_custkey = c.id
           WHERE request_id IN (SELECT request_id FROM decisions WHERE accepted)""",
    ),
    "conflict_report": (
        _queue(NO_HOLDS),
        """SELECT request_id, r.showtime_id, d.rejected_seat,
                  'Seat ID ' || d.rejected_seat || ' is unavailable.' AS details
           FROM decisions d JOIN requests r USING (request_id) WHERE NOT accepted""",
    ),
    "conflicts_per_showtime": (
        _queue(NO_HOLDS),
        """SELECT r.showtime_id, count(*) AS conflicts
           FROM decisions d JOIN requests r USING (request_id) WHERE NOT accepted GROUP BY 1""",
    ),
    "upsert_customers": """
        SELECT CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN id END AS known_id, email, name,
               c_mktsegment <> 'AUTOMOBILE' AS is_new
        FROM customers JOIN customer ON c_custkey = id
        WHERE c_mktsegment = 'AUTOMOBILE' OR email IN (SELECT customer_email FROM request_seats)""",
    "order_total": """
        SELECT request_id, CAST(count(*) * any_value(m.price) AS DECIMAL(20,2)) AS total
        FROM request_seats r JOIN showtimes s ON s.id = r.showtime_id JOIN movies m ON m.id = s.movie_id
        GROUP BY 1""",
    "dim_movies": f"""
        SELECT id AS movie_id, title, duration_minutes, price AS base_price,
               CAST(NULL AS VARCHAR) AS genre, CAST({AS_OF} AS TIMESTAMP) AS last_updated FROM movies""",
    "dim_time": (
        """, days AS (
          SELECT CAST(unnest(generate_series(min(payment_date)::DATE - INTERVAL 1 YEAR,
                                             max(payment_date)::DATE + INTERVAL 2 YEAR,
                                             INTERVAL 1 DAY)) AS DATE) AS date FROM payments)""",
        """SELECT date, dayname(date) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
                  CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(month(date) AS INTEGER) AS month_num,
                  monthname(date) AS month_name, CAST(quarter(date) AS INTEGER) AS quarter,
                  CAST(year(date) AS INTEGER) AS year, dayofweek(date) IN (0, 6) AS is_weekend,
                  false AS is_holiday FROM days""",
    ),
    "int_series": """
        SELECT payment_id, unnest(generate_series(1, count(*))) AS ordinal
        FROM tickets GROUP BY payment_id""",
    "date_series": """
        SELECT date, count(*) AS customers FROM (
          SELECT CAST(unnest(generate_series(min(payment_date)::DATE, max(payment_date)::DATE,
                                             INTERVAL 1 DAY)) AS DATE) AS date
          FROM payments GROUP BY customer_id) GROUP BY date""",
    "date_spine": """
        SELECT as_of, CAST(o AS INTEGER) AS "offset", strftime(as_of + INTERVAL 1 DAY * o, '%Y-%m-%d') AS day
        FROM (SELECT DISTINCT CAST(payment_date AS DATE) AS as_of FROM payments), range(7) r(o)""",
    "build_seats": "SELECT auditorium_id, row_code, number FROM seats",
    "build_showtimes": (
        """, plan AS (
          SELECT m.id AS movie_id, d AS day_offset, slot, hour, span
          FROM movies m, range(7) r(d), (VALUES (1, 10, 3), (2, 13, 4), (3, 17, 5)) s(slot, hour, span))""",
        f"""SELECT movie_id, movie_id % 10 AS auditorium_id, slot,
                   TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * day_offset
                   + INTERVAL 1 HOUR * (hour + {_hash("movie_id", "day_offset", "slot", "7", "'hour'")} % span)
                   + INTERVAL 30 MINUTE * ({_hash("movie_id", "day_offset", "slot", "7", "'minute'")} % 2)
                     AS start_time FROM plan""",
    ),
    "append_ignore_duplicates": """
        SELECT * FROM movies UNION ALL
        SELECT p_partkey, p_type, p_size, CAST(p_retailprice AS DECIMAL(10,2)) FROM part
        WHERE p_partkey NOT IN (SELECT id FROM movies)""",
    "append_with_defaults": f"""
        SELECT * FROM payments UNION ALL
        SELECT -id - 1, customer_id, amount, {HOLDS_AS_OF}, 'CREDIT_CARD' FROM payments""",
    "to_json_rows": """
        SELECT '{"booking_date":"' || strftime(payment_date::DATE, '%Y-%m-%dT00:00:00.000Z')
               || '","daily_revenue":"' || CAST(sum(amount) AS DECIMAL(20,2))
               || '","bookings":"' || count(*) || '"}' AS json
        FROM payments GROUP BY payment_date::DATE""",
    "calendar_columns": """
        SELECT id, CAST(payment_date AS DATE) AS booking_date, strftime(payment_date, '%H:%M:%S') AS booking_time,
               dayname(payment_date) AS day_of_week, CAST(weekofyear(payment_date) AS INTEGER) AS week_of_year,
               CAST(month(payment_date) AS INTEGER) AS month_num, monthname(payment_date) AS month_name,
               CAST(year(payment_date) AS INTEGER) AS year, CAST(quarter(payment_date) AS INTEGER) AS quarter,
               dayofweek(payment_date) IN (0, 6) AS is_weekend FROM payments""",
    "time_of_day_etl": _label(ETL_LABEL.format(HOUR)),
    "time_of_day_fn": _label(FN_LABEL.format(HOUR)),
    "slot4": _label(SLOT4),
    "day_type": _label(DAY_TYPE),
    "date_arithmetic": """
        SELECT id, payment_date + INTERVAL 1 HOUR AS plus_hour, payment_date + INTERVAL 15 MINUTE AS plus_quarter,
               payment_date - INTERVAL 30 DAY AS minus_month,
               date_trunc('day', payment_date) + INTERVAL 1 HOUR * (id % 24) + INTERVAL 1 MINUTE * (id % 60)
                 AS at_time,
               CAST(payment_date AS DATE) + CAST(id % 7 AS INTEGER) AS plus_days FROM payments""",
    "string_functions": """
        SELECT c_custkey AS id,
               lower(split_part(c_name, '#', 1)) || '.' || lower(split_part(c_name, '#', 2))
                 || CAST(CAST(floor(abs(c_acctbal) % 10000) AS BIGINT) AS VARCHAR) || '@example.com' AS email,
               replace(c_name, '#', ' ') AS name FROM customer""",
    "math_functions": """
        SELECT l_orderkey, l_linenumber, CAST((q * 2000 + w) // (2 * w) AS DOUBLE) / 10.0 AS pct,
               CAST(floor(l_extendedprice / 7) AS BIGINT) AS floored,
               l_extendedprice / nullif(l_linenumber - 1.0, 0) AS ratio
        FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity + l_linenumber AS BIGINT) AS w
              FROM lineitem)""",
    "array_functions": """
        SELECT request_id, CAST(count(*) OVER r AS INTEGER) AS seat_count, min(seat_id) OVER r AS lowest,
               max(seat_id) OVER r AS highest, seat_id
        FROM request_seats WINDOW r AS (PARTITION BY request_id)""",
    "json_functions": """
        SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               '{"id":' || event_id || ',"label":"' || event_type || '"}' AS document FROM events""",
    "json_first_showtime": """
        SELECT movie_id AS id, arg_min(id, start_time) AS showtime_id FROM showtimes
        WHERE CAST(start_time AS DATE) = DATE '2024-01-03' GROUP BY 1""",
    "json_first_available": (
        PAIRS,
        """SELECT showtime_id, min(seat_id) FILTER (NOT taken) AS seat_id FROM pairs GROUP BY 1""",
    ),
    "fmt_currency": f"""
        SELECT id, {_currency("amount")} AS amount_label,
               {_currency("CAST(amount * 0.3333 AS DECIMAL(18,6))")} AS third_label,
               {_currency("CASE WHEN id % 2 = 0 THEN amount END")} AS nullable_label FROM payments""",
    "fmt_axis": """
        SELECT id, '₱' || CASE
                 WHEN v >= 1000000 THEN CAST(CAST(round(v / 100000, 0) AS BIGINT) / 10.0 AS DECIMAL(20,1)) || 'M'
                 WHEN v >= 1000 THEN CAST(floor(v / 1000 + 0.5) AS BIGINT) || 'k'
                 ELSE regexp_replace(regexp_replace(CAST(v AS VARCHAR), '0+$', ''), '\\.$', '') END AS label
        FROM (SELECT id, CAST(amount * CASE id % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 1 ELSE 10 END
                              AS DECIMAL(20,5)) AS v FROM payments)""",
    "fmt_date_labels": """
        SELECT id, strftime(payment_date, '%b %-d') AS short_label, strftime(payment_date, '%B %-d, %Y') AS long_label,
               strftime(payment_date, '%a, %b %-d') AS weekday_label FROM payments""",
    "parse_numbers": """
        SELECT o_orderkey AS id, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS price,
               CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE
                    ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) END AS price_or_zero,
               CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) AS priority,
               CASE WHEN o_orderkey % 5 = 0 THEN 0
                    ELSE CAST(trunc(CAST(o_totalprice AS DECIMAL(12,2))) AS BIGINT) END AS whole_or_zero,
               CAST(NULL AS BIGINT) AS no_number FROM orders""",
    "seat_grid_column": """
        SELECT id, number, CAST(number + (number > 5)::INTEGER + (number > 15)::INTEGER AS INTEGER) AS grid_column
        FROM seats""",
    "latency_summary": (", " + LATENCY, "SELECT * FROM latency"),
    "sla_check": (
        ", " + LATENCY,
        """SELECT *, avg_ok AND p90_ok AND p95_ok AND throughput_ok AND errors_ok AS all_ok
           FROM (SELECT label, avg_ms < 500 AS avg_ok, p90_ms < 1000 AS p90_ok, p95_ms < 2000 AS p95_ok,
                        throughput_per_s > 100 AS throughput_ok, error_rate < 0.01 AS errors_ok FROM latency)""",
    ),
    "slowest_labels": """
        SELECT event_type AS label, count(*) AS calls, round(sum(value), 6) AS total_ms,
               round(avg(value), 6) AS mean_ms, max(value) AS max_ms
        FROM events GROUP BY 1 ORDER BY total_ms DESC, label LIMIT 10""",
}

# The same results, by way of the published fact.
SQL["load_fact"] = SQL["etl_summary"]
SQL["mv_movie_performance_refreshed"] = SQL["mv_movie_performance"]
SQL["analytics_summary_refreshed"] = SQL["analytics_summary"]
SQL["daily_revenue_published"] = SQL["daily_revenue"]

ORACLES = {
    name: MODEL + ("".join(sql) if isinstance(sql, tuple) else sql) for name, sql in SQL.items()
}
