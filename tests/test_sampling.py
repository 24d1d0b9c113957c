from __future__ import annotations

import numpy as np
import pytest
from cinema import BASE, NOON, hold
from frames import rows

from marquee.operators import sampling
from marquee.sources.schemas import OPERATIONAL


def winner_shares(ids, draws=400_000):
    """Shares of the winner when every movie draws a score of its own."""
    rng = np.random.default_rng(5)
    weights = 1 + np.array(ids) / 2
    best = np.argmax(rng.random((draws, len(ids))) * weights, axis=1)
    return np.bincount(best, minlength=len(ids)) / draws


@pytest.mark.parametrize("ids", [[1, 2, 3, 4, 5, 6], [0, 40, 41, 1000], [7]])
def test_weighted_pick_has_the_distribution_of_the_score_race(spark, ids):
    movies = spark.createDataFrame([(i,) for i in ids], "id long")
    requests = spark.range(40_000).withColumnRenamed("id", "request_id")
    picked = sampling.weighted_pick(requests, movies, seed=3)
    counts = dict(rows(picked.groupBy("movie_id").count()))
    assert sum(counts.values()) == 40_000 and picked.select("request_id").distinct().count() == 40_000
    got = np.array([counts.get(i, 0) / 40_000 for i in ids])
    assert np.abs(got - winner_shares(ids)).max() < 0.01


def test_bands_meet_whatever_the_parts(spark, monkeypatch):
    """Bands follow one another without gap or overlap, and those left out hold no draw."""
    movies = spark.range(5000)
    whole = sampling.popularity_bands(movies).orderBy("rank").collect()
    assert [r["rank"] for r in whole] == list(range(len(whole))) and len(whole) < 5000
    assert whole[0]["upper"] == 1.0 and whole[-1]["lower"] <= 2.0**-33
    monkeypatch.setattr(sampling, "RANK_PART", 7)
    parts = sampling.popularity_bands(movies).orderBy("rank").collect()
    assert [r["upper"] for r in parts] == pytest.approx([r["upper"] for r in whole])
    for bands in (whole, parts):
        assert all(a["lower"] == b["upper"] for a, b in zip(bands, bands[1:]))


def test_picked_seats_are_free_distinct_and_complete(make_model):
    held = [hold(1, 10, 101), hold(2, 10, 102), hold(3, 10, 103), hold(4, 12, 204)]
    m = make_model(**BASE, reservation_holds=held)
    got = rows(sampling.pick_available_seats(m, 3, seed=2))
    assert {s for s, _, _ in got} == {11, 12}  # showtime 10 has two free seats only
    assert len(got) == len({(s, seat) for s, _, seat in got}) == 6
    assert (12, 204) not in {(s, seat) for s, _, seat in got}
    assert got == rows(sampling.pick_available_seats(m, 3, seed=2))


def test_random_showtime_is_uniform_within_the_movie(spark, make_model):
    shows = [(n, n % 2, 1, NOON) for n in range(200)] + [(900, 2, 1, NOON)]
    movies = [(0, "a", 1, None), (1, "b", 1, None), (2, "c", 1, None)]
    m = make_model(showtimes=shows)
    m["movies"] = spark.createDataFrame(movies, OPERATIONAL["movies"])
    requests = spark.range(30_000).selectExpr("id AS request_id", "id % 3 AS movie_id")
    got = sampling.random_showtime_for_movie(requests, m, seed=4)
    assert got.count() == 30_000
    wrong = got.filter("CASE WHEN showtime_id = 900 THEN 2 ELSE showtime_id % 2 END <> movie_id")
    assert wrong.count() == 0
    counts = [r["count"] for r in got.filter("movie_id < 2").groupBy("showtime_id").count().collect()]
    assert len(counts) == 200 and min(counts) > 50 and max(counts) < 160
