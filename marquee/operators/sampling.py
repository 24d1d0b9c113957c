"""Repeatable random choices: seats per showtime, movies by popularity, showtimes per movie."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HASH_RANGE, draw_below, hash32, uniform
from ..sources.snapshots import Model
from .seating import free_seats, halls_of_showtimes

NUMBERING_BUCKETS = 64
# Ids whose ranks one task works out, and cells of the guide table.
RANK_PART = 1 << 16
CELLS = 1 << 14


def pick_available_seats(m: Model, k: int, seed: int = 1) -> DataFrame:
    """``k`` random free seats for every showtime that has that many, drawn inside its row."""
    luck = F.transform(
        free_seats(),
        lambda s: F.struct(
            hash32(s["seat_id"], "showtime_id", F.lit(seed)).alias("luck"), s["seat_id"].alias("seat_id")
        ),
    )
    return (
        halls_of_showtimes(m)
        .select("showtime_id", F.array_sort(luck).alias("drawn"))
        .filter(F.size("drawn") >= k)
        .select("showtime_id", F.posexplode(F.slice("drawn", 1, k)).alias("place", "seat"))
        .select("showtime_id", (F.col("place") + 1).alias("pick"), F.col("seat.seat_id").alias("seat_id"))
    )


def popularity_bands(movies: DataFrame) -> DataFrame:
    """Distribution of the winner of ``random() * (1 + id / 2)`` over all movies.

    With weights w, the highest score is at most x with probability F(x) = prod min(1, x / w).
    Given a highest score x, the winner is equally likely to be any movie with weight >= x.
    So band r (movies ranked by weight from 0) covers the draws between F(w[r+1]) and F(w[r])
    and has r + 1 equally likely winners.

    Ranks and running sums are taken in parts of RANK_PART ids and added up over the parts, so
    that no task sees all movies. Bands that end below the smallest possible draw hold none and
    are left out. Movies without an id cannot win.
    """
    weighed = (
        movies.select(F.col("id").alias("movie_id"))
        .dropna()
        .withColumn("part", F.floor(F.col("movie_id") / RANK_PART))
        .withColumn("log_w", F.log(F.lit(1.0) + F.col("movie_id") / F.lit(2.0)))
    )
    by_part = Window.orderBy(F.desc("part"))
    above = by_part.rowsBetween(Window.unboundedPreceding, -1)
    edge = F.exp(F.col("ranks_above") * F.col("top") - F.col("logs_above"))
    parts = (
        weighed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("log_w").alias("logs"), F.max("log_w").alias("top"))
        .withColumn("ranks_above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        .withColumn("logs_above", F.coalesce(F.sum("logs").over(above), F.lit(0.0)))
        .withColumn("next_edge", F.lead(edge).over(by_part))  # where the part's last band ends
        .select("part", "ranks_above", "logs_above", "next_edge")
    )
    within = Window.partitionBy("part").orderBy(F.desc("movie_id"))
    before = F.coalesce(F.sum("log_w").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = (
        weighed.join(parts, "part")
        .withColumn("rank", F.col("ranks_above") + F.row_number().over(within) - 1)
        .withColumn("upper", F.exp(F.col("rank") * F.col("log_w") - (F.col("logs_above") + before)))
    )
    lower = F.coalesce(F.lead("upper").over(within), F.col("next_edge"), F.lit(0.0))
    return ranked.select("movie_id", "rank", lower.alias("lower"), "upper").filter(
        F.col("upper") > 0.5 / HASH_RANGE
    )


def weighted_pick(requests: DataFrame, movies: DataFrame, seed: int = 1) -> DataFrame:
    """One movie per request, favouring high ids as the weighted random order does.

    The draw is looked up in a guide table: [0, 1) is cut into CELLS cells and a band is listed
    under each cell it touches. Requests join on their cell; the number of bands grows with the
    root of the highest id, so the candidates per request stay few on average.
    """
    bands = popularity_bands(movies)
    first = F.floor(F.col("lower") * CELLS)
    last = F.least(F.floor(F.col("upper") * CELLS), F.lit(CELLS - 1).cast("bigint"))
    guide = bands.select("rank", "lower", "upper", F.explode(F.sequence(first, last)).alias("cell"))
    drawn = requests.select(
        "request_id", uniform("request_id", F.lit(seed), F.lit("band")).alias("u")
    ).withColumn("cell", F.floor(F.col("u") * CELLS))
    banded = drawn.join(guide, "cell").filter("u > lower AND u <= upper")
    winner = draw_below(F.col("rank") + 1, "request_id", F.lit(seed), F.lit("winner"))
    return (
        banded.select("request_id", winner.alias("rank"))
        .join(bands.select("rank", "movie_id"), "rank")
        .select("request_id", "movie_id")
    )


def _numbered_showtimes(m: Model) -> tuple[DataFrame, DataFrame]:
    """Showtimes numbered from 0 within their movie, and the count per movie.

    Numbers run bucket by bucket (id modulo a constant), so even a movie with a large share of
    all showtimes is numbered by many tasks.
    """
    bucket = F.pmod(F.col("id"), F.lit(NUMBERING_BUCKETS))
    shows = m["showtimes"].dropna(subset=["movie_id"]).withColumn("bucket", bucket)
    sizes = shows.groupBy("movie_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_bucket = Window.partitionBy("movie_id").orderBy("bucket")
    starts = sizes.select(
        "movie_id", "bucket", (F.sum("n").over(by_bucket) - F.col("n")).alias("start")
    )
    within = Window.partitionBy("movie_id", "bucket").orderBy("id")
    numbered = (
        shows.withColumn("place", F.row_number().over(within) - 1)
        .join(starts, ["movie_id", "bucket"])
        .withColumn("position", F.col("start") + F.col("place"))
        .drop("bucket", "place", "start")
    )
    return numbered, sizes.groupBy("movie_id").agg(F.sum("n").alias("showtimes"))


def random_showtime_for_movie(requests: DataFrame, m: Model, seed: int = 1) -> DataFrame:
    """One random showtime of the wanted movie per request (request_id, movie_id).

    A request draws a position and joins the one showtime there, never the whole list.
    """
    numbered, counts = _numbered_showtimes(m)
    prices = m["movies"].select(F.col("id").alias("movie_id"), "price")
    wanted = (
        requests.join(counts, "movie_id")
        .withColumn("position", draw_below("showtimes", "request_id", F.lit(seed), F.lit("showtime")))
        .select("request_id", "movie_id", "position")
    )
    shows = numbered.select("movie_id", "position", F.col("id").alias("showtime_id"), "auditorium_id")
    return (
        wanted.join(shows, ["movie_id", "position"])
        .join(prices, "movie_id")
        .select("request_id", "movie_id", "showtime_id", "auditorium_id", "price")
    )


