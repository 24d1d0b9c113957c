from __future__ import annotations

import json
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from cinema import BASE, hold, money
from frames import rows
from pyspark.sql import functions as F

from marquee.operators.reports import daily_revenue, mv_daily_revenue
from marquee.plans.dimensions import DIM_TIME_COLUMNS, calendar_bounds, dim_movies, dim_time
from marquee.plans.refresh import refresh_all_reports
from marquee.sinks.json_rows import to_json_rows
from marquee.sinks.keys import with_surrogate_key
from marquee.sinks.tables import (
    append_ignore_duplicates,
    append_with_defaults,
    collect_table_stats,
    new_rows,
    write_full_refresh,
)
from marquee.sources.request_log import as_samples, read_request_log
from marquee.sources.schemas import DIM_TIME, HOLD_DEFAULTS, OPERATIONAL
from marquee.sources.seed_rows import seed_fact_rows
from marquee.sources.snapshots import (
    JdbcSource,
    load_booking_model,
    read_fact,
    split_predicates,
    split_query,
)

AS_OF = date(2025, 11, 18)


def test_full_refresh_replaces_and_prunes(spark, tmp_path):
    path = str(tmp_path / "fact")
    fact = seed_fact_rows(spark, AS_OF)
    write_full_refresh(fact.limit(3), path)
    write_full_refresh(fact, path)
    back = spark.read.parquet(path)
    assert back.count() == 21 and os.listdir(tmp_path) == ["fact"]
    plan = back.filter("year = 2025 AND month_num = 11")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_published_fact_is_read_by_month(spark, tmp_path):
    path = str(tmp_path / "fact")
    october = seed_fact_rows(spark, AS_OF).withColumn("month_num", F.lit(10)).withColumn("id", -F.col("id"))
    write_full_refresh(seed_fact_rows(spark, AS_OF).unionByName(october), path)
    recent = read_fact(spark, path, AS_OF)
    assert recent.columns[:3] == ["id", "booking_date", "booking_time"] and recent.count() == 21
    assert read_fact(spark, path).count() == 42
    plan = daily_revenue(recent, AS_OF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(booking_date), GreaterThanOrEqual(booking_date" in plan
    assert "PartitionFilters: [((year" in plan


def test_failed_refresh_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "fact")
    fact = seed_fact_rows(spark, AS_OF)
    write_full_refresh(fact, path)
    broken = fact.withColumn("movie_id", F.raise_error(F.lit("boom")).cast("long"))
    with pytest.raises(Exception, match="boom"):
        write_full_refresh(broken, path)
    assert spark.read.parquet(path).count() == 21


def test_refresh_all_reports(spark, tmp_path):
    fact = seed_fact_rows(spark, AS_OF)
    write_full_refresh(fact, str(tmp_path / "fact"))
    for _ in range(2):
        written = refresh_all_reports(spark, str(tmp_path / "fact"), str(tmp_path / "reports"))
    assert set(written) == {"mv_daily_revenue", "mv_movie_performance", "mv_timeslot_analysis"}
    assert rows(spark.read.parquet(written["mv_daily_revenue"])) == rows(mv_daily_revenue(fact))


def test_append_ignores_known_and_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "c"), (2, "b"), (None, "n"), (None, "n")], "k int, v string")
    got = rows(append_ignore_duplicates(old, new, ["k"]))
    assert got == [(1, "a"), (2, "b"), (None, "n"), (None, "n")]
    once = append_ignore_duplicates(old, new.dropna(), ["k"])
    assert rows(append_ignore_duplicates(once, new.dropna(), ["k"])) == rows(once)
    assert rows(new_rows(old.select("k"), new.select("k").dropna(), ["k"])) == [(2,)]


def test_defaults_fill_missing_columns_only(spark, make_model):
    holds = make_model(**BASE, reservation_holds=[hold(1, 10, 101)])["reservation_holds"]
    bare = holds.drop("status").withColumn("id", F.lit(2))
    given = holds.withColumn("id", F.lit(3)).withColumn("status", F.lit(None).cast("string"))
    got = append_with_defaults(append_with_defaults(holds, bare, HOLD_DEFAULTS), given, HOLD_DEFAULTS)
    assert rows(got, "id", "status") == [(1, "CONFIRMED"), (2, "CONFIRMED"), (3, None)]
    assert got.schema == OPERATIONAL["reservation_holds"] or got.dtypes == holds.dtypes


def test_surrogate_keys_are_unique_and_repeatable(spark):
    df = spark.range(5000).selectExpr("id AS k", "id % 7 AS v").repartition(7)
    keyed = with_surrogate_key(df, ["k"], start=100, buckets=16)
    assert keyed.select("id").distinct().count() == 5000 and keyed.agg(F.min("id")).first()[0] >= 100
    assert keyed.agg(F.max("id")).first()[0] < 100 + 5000 * 1.5
    assert rows(keyed) == rows(with_surrogate_key(df.coalesce(1), ["k"], start=100, buckets=16))


def test_json_rows(spark):
    df = spark.createDataFrame(
        [(1, Decimal("10.50"), date(2025, 11, 7), datetime(2025, 11, 7, 8, 9, 10), 1.5, None, True)],
        "n long, amount decimal(10,2), day date, at timestamp_ntz, avg double, gone string, ok boolean",
    )
    assert json.loads(to_json_rows(df).first()["json"]) == {
        "n": "1",
        "amount": "10.50",
        "day": "2025-11-07T00:00:00.000Z",
        "at": "2025-11-07T08:09:10.000Z",
        "avg": 1.5,
        "gone": None,
        "ok": True,
    }


def test_table_statistics(spark):
    spark.range(10).write.mode("overwrite").saveAsTable("numbers")
    try:
        collect_table_stats(spark, "numbers")
        details = {r[0]: r[1] for r in spark.sql("DESCRIBE EXTENDED numbers id").collect()}
        assert details["distinct_count"] == "10"
    finally:
        spark.sql("DROP TABLE numbers")


def test_model_from_parquet_folder(spark, make_model, tmp_path):
    m = make_model(**BASE)
    for name, df in m.items():
        df.write.parquet(str(tmp_path / name))
    loaded = load_booking_model(spark, str(tmp_path))
    assert rows(loaded["showtimes"]) == rows(m["showtimes"])
    assert loaded["payments"].dtypes == m["payments"].dtypes


def test_jdbc_options_split_the_id_range():
    options = JdbcSource("jdbc:x", {"user": "u"}, partitions=8).options("tickets", 1, 100)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "8"
    assert (options["lowerBound"], options["upperBound"], options["user"]) == ("1", "101", "u")


def test_jdbc_parts_hold_equally_many_rows():
    """Skewed ids, a value that is missing, and tables of few rows, in a database of this process."""
    duck = duckdb.connect()
    ids = [*range(1, 800), *range(10**6, 10**6 + 150), 10**9, None]
    for name, part in (("many", ids), ("few", ids[:3]), ("none", [])):
        duck.execute(f"CREATE TABLE {name} (id BIGINT)")
        if part:
            duck.executemany(f"INSERT INTO {name} VALUES (?)", [(x,) for x in part])
        points = [row[0] for row in duck.execute(split_query(name, 8)).fetchall()]
        predicates = split_predicates(points)
        count = lambda where, name=name: duck.execute(f"SELECT count(*) FROM {name} WHERE {where}").fetchone()[0]
        sizes = [count(p) for p in predicates]
        assert sum(sizes) == len(part)  # with the next line: each row meets exactly one
        assert count(" OR ".join(f"({p})" for p in predicates)) == len(part)
        assert max(sizes) <= len(part) // 8 + 2


def test_calendar_dimension(spark):
    days = dim_time(calendar_bounds(spark, AS_OF))
    assert days.columns == DIM_TIME_COLUMNS and dict(days.dtypes) == {
        f.name: f.dataType.simpleString() for f in DIM_TIME
    }
    assert days.agg(F.min("date"), F.max("date"), F.count("*")).first() == (
        date(2024, 11, 18),
        date(2027, 11, 18),
        1096,
    )
    marked = days.limit(5).withColumn("is_holiday", F.lit(True))
    again = dim_time(calendar_bounds(spark, AS_OF), marked)
    assert again.count() == 1096 and again.filter("is_holiday").count() == 5


def test_movie_dimension(make_model):
    row = dim_movies(make_model(**BASE)["movies"], F.lit("2025-11-18")).orderBy("movie_id").first()
    assert (row["base_price"], row["genre"], row["last_updated"]) == (money(250), None, datetime(2025, 11, 18))


def test_request_log_csv(spark, tmp_path):
    header = (
        "timeStamp,elapsed,label,responseCode,responseMessage,threadName,dataType,success,bytes,"
        "sentBytes,grpThreads,allThreads,URL,Latency,IdleTime,Connect"
    )
    line = "1700000000000,25,schedule,200,OK,t 1-1,text,true,10,5,1,1,http://x,20,0,1"
    (tmp_path / "log.csv").write_text(f"{header}\n{line}\n")
    log = read_request_log(spark, str(tmp_path / "log.csv"))
    assert rows(as_samples(log)) == [(1.7e12, 25.0, "schedule", True)]


def test_request_log_with_all_columns_and_with_few(spark, tmp_path):
    header = (
        "timeStamp,elapsed,label,responseCode,responseMessage,threadName,dataType,success,failureMessage,"
        "bytes,sentBytes,grpThreads,allThreads,URL,Latency,IdleTime,Connect"
    )
    line = '1700000000000,25,schedule,500,no,t 1-1,text,false,"a, b",10,5,1,2,http://x,20,0,3'
    (tmp_path / "all.csv").write_text(f"{header}\n{line}\n")
    row = read_request_log(spark, str(tmp_path / "all.csv")).first()
    assert (row["failureMessage"], row["bytes"], row["sentBytes"], row["URL"]) == ("a, b", 10, 5, "http://x")
    assert (row["allThreads"], row["Latency"], row["Connect"], row["success"]) == (2, 20, 3, False)
    (tmp_path / "few.csv").write_text("success,label,Latency,elapsed,timeStamp\ntrue,seats,4,9,1700000000001\n")
    few = read_request_log(spark, str(tmp_path / "few.csv"))
    assert rows(as_samples(few)) == [(1700000000001.0, 9.0, "seats", True)]
    assert (few.first()["Latency"], few.first()["URL"]) == (4, None)


@pytest.mark.parametrize("header", ["timeStamp,elapsed,label,success,other", "timeStamp,elapsed,label"])
def test_other_logs_are_refused(spark, tmp_path, header):
    (tmp_path / "log.csv").write_text(f"{header}\n1,2,x,true,y\n")
    with pytest.raises(ValueError, match="not a result log"):
        read_request_log(spark, str(tmp_path / "log.csv"))
