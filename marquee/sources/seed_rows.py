"""Sample fact rows for demos and golden tests."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from .schemas import FACT_BOOKINGS

# Movie id -> title, minutes, price.
MOVIES = {
    1: ("Quezon", 120, "250.00"),
    2: ("Predator: Badlands", 130, "300.00"),
    3: ("Die, My Love", 110, "220.00"),
    4: ("Bugonia", 115, "200.00"),
    5: ("Wicked: For Good", 140, "280.00"),
    6: ("Meet, Greet & Bye", 105, "180.00"),
}

# Days ago, booking time, movie, auditorium, customer, seats, revenue, method,
# weekday, ISO week, weekend, time of day. Labels are kept as typed. Row n is showtime n and
# customer n.
ROWS = [
    (1, "14:30:00", 1, 1, "John Doe", 2, "500.00", "CREDIT_CARD", "Monday", 47, False, "Afternoon"),
    (1, "19:00:00", 1, 1, "Jane Smith", 3, "750.00", "CREDIT_CARD", "Monday", 47, False, "Evening"),
    (2, "14:30:00", 1, 2, "Bob Johnson", 1, "250.00", "DEBIT_CARD", "Sunday", 46, True, "Afternoon"),
    (1, "16:00:00", 2, 2, "Alice Brown", 2, "600.00", "CREDIT_CARD", "Monday", 47, False, "Afternoon"),
    (1, "21:00:00", 2, 1, "Charlie Wilson", 4, "1200.00", "CREDIT_CARD", "Monday", 47, False, "Night"),
    (3, "19:00:00", 2, 1, "David Lee", 2, "600.00", "CASH", "Saturday", 46, True, "Evening"),
    (2, "15:30:00", 3, 3, "Emma Davis", 1, "220.00", "CREDIT_CARD", "Sunday", 46, True, "Afternoon"),
    (2, "18:00:00", 3, 2, "Frank Miller", 2, "440.00", "DEBIT_CARD", "Sunday", 46, True, "Evening"),
    (4, "14:00:00", 3, 1, "Grace Taylor", 3, "660.00", "CREDIT_CARD", "Friday", 46, False, "Afternoon"),
    (3, "13:00:00", 4, 3, "Henry White", 1, "200.00", "CREDIT_CARD", "Saturday", 46, True, "Afternoon"),
    (3, "20:00:00", 4, 2, "Iris Green", 2, "400.00", "CASH", "Saturday", 46, True, "Evening"),
    (1, "17:00:00", 5, 3, "Jack Black", 4, "1120.00", "CREDIT_CARD", "Monday", 47, False, "Evening"),
    (2, "19:30:00", 5, 1, "Kate Brown", 3, "840.00", "CREDIT_CARD", "Sunday", 46, True, "Evening"),
    (5, "16:00:00", 5, 2, "Leo Martinez", 2, "560.00", "DEBIT_CARD", "Thursday", 46, False, "Afternoon"),
    (4, "15:00:00", 6, 3, "Mia Thompson", 1, "180.00", "CREDIT_CARD", "Friday", 46, False, "Afternoon"),
    (4, "20:30:00", 6, 1, "Noah Garcia", 2, "360.00", "CASH", "Friday", 46, False, "Night"),
    (6, "14:00:00", 6, 2, "Olivia Wilson", 3, "540.00", "CREDIT_CARD", "Wednesday", 46, False, "Afternoon"),
    (7, "10:00:00", 1, 1, "Paul Anderson", 2, "500.00", "CREDIT_CARD", "Tuesday", 46, False, "Morning"),
    (8, "11:30:00", 2, 2, "Quinn Roberts", 1, "300.00", "DEBIT_CARD", "Monday", 46, False, "Morning"),
    (9, "12:00:00", 3, 3, "Rachel King", 4, "880.00", "CREDIT_CARD", "Sunday", 45, True, "Afternoon"),
    (10, "13:30:00", 4, 1, "Sam Turner", 2, "400.00", "CASH", "Saturday", 45, True, "Afternoon"),
]

# Month, quarter and year as typed on every row.
MONTH_NUM, MONTH_NAME, QUARTER, YEAR = 11, "November", 4, 2025


def seed_fact_rows(spark: SparkSession, as_of: date) -> DataFrame:
    """The sample rows with their dates counted back from ``as_of``."""
    rows = []
    for number, row in enumerate(ROWS, start=1):
        ago, clock, movie, hall, person, seats, revenue, method, dow, week, weekend, label = row
        title, minutes, price = MOVIES[movie]
        day = as_of - timedelta(days=ago)
        moment = datetime.combine(day, time())
        email = f"{person.split()[0].lower()}@example.com"
        rows.append(
            (number, day, clock, moment, movie, title, minutes, Decimal(price), number, moment)
            + (hall, f"Cinema {hall}", number, email, person, seats, Decimal(revenue), method)
            + (dow, week, MONTH_NUM, MONTH_NAME, YEAR, QUARTER, weekend, label)
        )
    return spark.createDataFrame(rows, FACT_BOOKINGS)
