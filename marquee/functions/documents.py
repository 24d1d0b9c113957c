"""Reading values out of JSON response texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import Col, _col

SEAT_LIST = "array<struct<id:bigint,row_code:string,number:int,status:string>>"


def first_showtime_id(showtimes: Col) -> Column:
    """Id of the first entry of a showtime list."""
    return F.get_json_object(_col(showtimes), "$[0].id").cast("bigint")


def first_available_seat(seats: Col) -> Column:
    """Id of the first seat of a seat list that is still available, null without one."""
    listed = F.from_json(_col(seats), SEAT_LIST)
    return F.get(F.filter(listed, lambda s: s["status"] == "available"), 0)["id"]
