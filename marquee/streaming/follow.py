"""The booking fact and the daily revenue, kept up to date by signed deltas.

A micro-batch brings rows of any of the published tables. What they take back of a table and what
they add to it are its differences (``n`` = -1 and 1), and the differences of a join follow from
those of its sides: the changed rows of one meet what the other holds after the batch, and what the
first held before the batch meets the changed rows of the other. So the fact follows in three
steps, each with a store by the key of the next: tickets of a reservation, seats of a payment and
showtime, seats at the fact grain by month. Nothing is read of keys that the batch does not touch,
and a step without a changed side, or with an empty one, is not run.

The months whose seats changed are written again, and so are the months that a changed customer,
showtime, movie or auditorium has bookings in, which an index tells. Seats are counted whether or
not their customer, showtime, movie or auditorium is there yet, so what comes before its parents
waits in the store and appears with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import money_sum
from ..plans.fact import GRAIN, described, month_number
from ..sinks import files
from ..sinks.tables import overwrite_partitions
from ..sources.schemas import OPERATIONAL
from .feed import PUBLISHED, of_table
from .store import BUCKETS, RunStore, hashed, summed
from .versions import Links, Versions, latest, live

FACT_PARTITIONS = ["year", "month_num"]
# Columns that are kept of tables of which the fact needs but these.
NEEDED = {"tickets": ["id", "reservation_id", "payment_id"], "reservation_holds": ["id", "showtime_id"]}
# Parents whose showtimes are found when they change or come late.
PARENTS = {"movies": "movie_id", "auditoriums": "auditorium_id"}


def _counts(*keys: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.LongType()) for name in (*keys, "n")])


_GRAINS = T.StructType(
    [
        *[f for f in OPERATIONAL["payments"].fields if f.name in GRAIN],
        T.StructField("showtime_id", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)
_DAYS = T.StructType(
    [
        T.StructField("booking_date", T.DateType()),
        T.StructField("daily_revenue", T.DecimalType(20, 2)),
        T.StructField("bookings", T.LongType()),
        T.StructField("priced", T.LongType()),  # bookings that have an amount
    ]
)


def _totals(rows: DataFrame) -> DataFrame:
    """Differences by day, added up; a day may change its revenue alone."""
    totals = rows.groupBy("booking_date").agg(
        F.sum("daily_revenue").cast("decimal(20,2)").alias("daily_revenue"),
        F.sum("bookings").alias("bookings"),
        F.sum("priced").alias("priced"),
    )
    return totals.filter("bookings <> 0 OR daily_revenue <> 0 OR priced <> 0")


class FactFollower:
    """What the fact needs to know between micro-batches, in stores under ``state``."""

    def __init__(self, spark: SparkSession, state: str, fact_path: str, buckets: int = BUCKETS):
        self.spark, self.fact_path, self.work = spark, fact_path.rstrip("/"), f"{state}/work"
        self.tables = {name: Versions(spark, state, name, buckets, NEEDED.get(name)) for name in PUBLISHED}
        # movies and auditoriums to their showtimes
        self.links = Links(spark, state, "links", buckets)
        # (kind, key) of customers and showtimes to the months they have bookings in
        self.months = Links(spark, state, "months", buckets)

        def counts(name: str, *keys: str) -> RunStore:
            bucket, fold = hashed(keys[0], buckets=buckets), summed(*keys)
            return RunStore(spark, f"{state}/{name}", _counts(*keys), bucket, fold, keys=keys, dealt=buckets)

        self.reserved = counts("reserved", "reservation_id", "payment_id")
        self.seats = counts("seats", "payment_id", "showtime_id")
        month = month_number().cast("long")
        self.grains = RunStore(spark, f"{state}/grains", _GRAINS, month, summed(*GRAIN), keys=GRAIN)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Apply one micro-batch of ``read_all_changes``; applying it again changes nothing."""
        if self.tables["tickets"].store.runs(batch_id) and not self.reserved.kept(batch_id):
            raise ValueError("the state lacks tickets by reservation: it is of an earlier version, begin anew")
        # every run is written once, and counts when all of the batch is done
        runs = []
        new = {}
        for name, versions in self.tables.items():
            if not set(versions.store.schema.names) <= set(batch.columns):
                if batch.filter(F.col("table") == name).isEmpty():
                    continue
            run = versions.store.put(of_table(batch, name), batch_id)
            if run["buckets"]:
                runs.append((versions.store, run))
                new[name] = versions.store.rows(run)
        self._apply(new, batch_id, runs)
        for store, run in runs:
            store.add(run, batch_id)
        files.remove(self.spark, self.work)

    def _put(
        self, store: RunStore, rows: DataFrame, batch_id: int, runs: list, folded: bool = False
    ) -> DataFrame | None:
        """The rows of a batch in the run that its store will get, None without any."""
        run = store.put(rows, batch_id, folded)
        runs.append((store, run))
        return store.rows(run) if run["buckets"] else None

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """What several steps of a batch read, as a table: a plan stays as short as its step."""
        path = f"{self.work}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _after(self, name: str, new: dict[str, DataFrame], batch_id: int, ids: DataFrame | None = None) -> DataFrame:
        """Rows after a batch: those of ``ids``, or all, and perhaps others."""
        store = self.tables[name].store
        if not store.folders(batch_id):
            return live(new[name] if name in new else store.read(batch_id))
        if ids is not None:
            before = store.find(batch_id, ids, others=name not in new)
        else:
            before = store.read(batch_id)
        return live(latest(before.unionByName(new[name])) if name in new else before)

    def _changed(self, name: str, new: dict[str, DataFrame], batch_id: int) -> DataFrame | None:
        """Rows that a batch takes back (``n`` = -1) and adds (1), None if it has none of the table."""
        if name not in new:
            return None
        store, rows = self.tables[name].store, new[name]
        if not store.folders(batch_id):
            return live(rows).withColumn("n", F.lit(1).cast("long"))
        before = self._keep(store.find(batch_id, rows.select("id")), f"old-{name}")
        gone = live(before).withColumn("n", F.lit(-1).cast("long"))
        return gone.unionByName(live(latest(before.unionByName(rows))).withColumn("n", F.lit(1).cast("long")))

    def _has(self, name: str, new: dict[str, DataFrame], batch_id: int) -> bool:
        return name in new or bool(self.tables[name].store.folders(batch_id))

    def _apply(self, new: dict[str, DataFrame], batch_id: int, runs: list) -> None:
        deltas = self._deltas(new, batch_id, runs)
        months, fresh = set(), None
        if deltas is not None:
            months = set(runs[-1][1]["buckets"])
            dated = deltas.withColumn("month", month_number())
            kinds = [self.months.rows(kind, dated, kind, "month") for kind in ("customer_id", "showtime_id")]
            self._put(self.months.store, kinds[0].unionByName(kinds[1]), batch_id, runs)
        if "showtimes" in new:
            shows = live(new["showtimes"])
            kinds = [self.links.rows(kind, shows, kind) for kind in PARENTS.values()]
            fresh = self._put(self.links.store, kinds[0].unionByName(kinds[1]), batch_id, runs)
        months |= self._months_of_parents(new, fresh, set(self.grains.buckets(batch_id)) - months, batch_id)
        if months:
            self._write_months(sorted(months), new, deltas, batch_id)

    def _deltas(self, new: dict[str, DataFrame], batch_id: int, runs: list) -> DataFrame | None:
        """Seats at the fact grain that are there after the batch and were not before it, or the
        other way round; None without any."""
        reserved = self._changed("tickets", new, batch_id)
        if reserved is not None:
            reserved = reserved.select(*self.reserved.schema.names).dropna()
            reserved = self._put(self.reserved, reserved, batch_id, runs)
        sides = []
        if reserved is not None and self._has("reservation_holds", new, batch_id):
            ids = reserved.select(F.col("reservation_id").alias("id"))
            holds = self._after("reservation_holds", new, batch_id, ids)
            holds = holds.select(F.col("id").alias("reservation_id"), "showtime_id")
            sides.append(reserved.join(holds, "reservation_id"))
        if "reservation_holds" in new and self.reserved.folders(batch_id):
            holds = self._changed("reservation_holds", new, batch_id)
            holds = holds.select(F.col("id").alias("reservation_id"), "showtime_id", F.col("n").alias("times"))
            ids = new["reservation_holds"].select(F.col("id").alias("reservation_id"))
            before = self.reserved.find(batch_id, ids, others=True)
            sides.append(before.join(holds, "reservation_id").withColumn("n", F.col("n") * F.col("times")))
        seats = self._put_sides(self.seats, sides, batch_id, runs)

        sides = []
        dated = F.col("payment_date").isNotNull()
        if seats is not None and self._has("payments", new, batch_id):
            payments = self._after("payments", new, batch_id, seats.select(F.col("payment_id").alias("id")))
            payments = payments.filter(dated).withColumnRenamed("id", "payment_id")
            sides.append(seats.join(payments, "payment_id"))
        if "payments" in new and self.seats.folders(batch_id):
            payments = self._changed("payments", new, batch_id).filter(dated)
            payments = payments.withColumnsRenamed({"id": "payment_id", "n": "times"})
            before = self.seats.find(batch_id, new["payments"].select(F.col("id").alias("payment_id")), others=True)
            sides.append(before.join(payments, "payment_id").withColumn("n", F.col("n") * F.col("times")))
        return self._put_sides(self.grains, sides, batch_id, runs)

    def _put_sides(self, store: RunStore, sides: list[DataFrame], batch_id: int, runs: list) -> DataFrame | None:
        """Differences of a join in the run of their store. They are added up before they are dealt,
        as a key may have very many."""
        if not sides:
            return None
        rows = sides[0].select(*store.schema.names)
        for side in sides[1:]:
            rows = rows.unionByName(side.select(*store.schema.names))
        return self._put(store, store.fold(rows), batch_id, runs, folded=True)

    def _months_of_parents(
        self, new: dict[str, DataFrame], fresh: DataFrame | None, open_: set[int], batch_id: int
    ) -> set[int]:
        """Months with bookings of the customers, showtimes, movies and auditoriums of a batch, of
        the months ``open_`` that are not written anyway."""
        months: set[int] = set()
        if "customers" in new and open_:
            found = self.months.children(batch_id, "customer_id", new["customers"].select("id"))
            months |= {r[0] for r in found.collect()} & open_
        if {"showtimes", *PARENTS} & new.keys() and open_ - months:
            none = self.spark.createDataFrame([], "id long")
            shows = new["showtimes"].select("id") if "showtimes" in new else none
            for table, parent in PARENTS.items():
                if table in new:
                    shows = shows.unionByName(self.links.children(batch_id, parent, new[table].select("id"), fresh))
            shows = self._keep(shows.dropna().distinct(), "touched-showtimes")
            found = self.months.children(batch_id, "showtime_id", shows)
            months |= {r[0] for r in found.collect()} & open_
        return months

    def _write_months(self, months: list[int], new, deltas: DataFrame | None, batch_id: int) -> None:
        booked = self.grains.read(batch_id, months)
        if deltas is not None and self.grains.folders(batch_id, months):
            booked = self._keep(self.grains.fold(booked.unionByName(deltas)), "booked")
        elif deltas is not None:
            booked = deltas
        elif not self.grains.alone(batch_id, months):
            booked = self._keep(booked, "booked")
        m = {}
        for name, key in (("customers", "customer_id"), ("showtimes", "showtime_id")):
            wanted = None
            if set(self.grains.buckets(batch_id)) - set(months):  # else all but few have bookings
                wanted = booked.select(F.col(key).alias("id")).dropna().distinct()
            m[name] = self._after(name, new, batch_id, wanted)
        for name in PARENTS:
            m[name] = self._after(name, new, batch_id)
        folders = {month: self._folder(month) for month in months}
        before = {month: files.children(self.spark, folder) for month, folder in folders.items()}
        overwrite_partitions(described(booked, m, by_month=True), self.fact_path, FACT_PARTITIONS, spread=True)
        for month, folder in folders.items():
            # files of a month that is written have new names, so this one has lost its last row
            if before[month] and files.children(self.spark, folder) == before[month]:
                files.remove(self.spark, folder)

    def _folder(self, month: int) -> str:
        year, number = divmod(month - 1, 12)
        return f"{self.fact_path}/year={year}/month_num={number + 1}"


class RevenueFollower:
    """Revenue per day of the payment feed, kept by the differences that changed payments make."""

    def __init__(self, spark: SparkSession, state: str, out: str, buckets: int = BUCKETS):
        self.spark, self.out = spark, out.rstrip("/")
        self.payments = Versions(spark, state, "payments", buckets)
        self.days = RunStore(spark, f"{state}/days", _DAYS, hashed("booking_date", buckets=buckets), _totals)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Apply one micro-batch of payment rows; applying it again changes nothing."""
        new = latest(batch)
        before = self.payments.before(batch_id, new.select("id"))
        deltas = None
        for sign, rows in ((-1, before), (1, latest(before.unionByName(new)))):
            paid = live(rows).filter(F.col("payment_date").isNotNull())
            side = paid.groupBy(F.to_date("payment_date").alias("booking_date")).agg(
                (money_sum("amount") * sign).alias("daily_revenue"),
                (F.count(F.lit(1)) * sign).alias("bookings"),
                (F.count("amount") * sign).alias("priced"),
            )
            deltas = side if deltas is None else deltas.unionByName(side)
        deltas = _totals(deltas).persist()
        days = deltas.select("booking_date")
        totals = _totals(self.days.find(batch_id, days).unionByName(deltas)).filter("bookings <> 0").persist()
        left = {r[0] for r in totals.select("booking_date").collect()}
        for day in sorted({r[0] for r in days.collect()} - left):
            files.remove(self.spark, f"{self.out}/booking_date={day}")
        revenue = F.when(F.col("priced") > 0, F.col("daily_revenue")).alias("daily_revenue")
        overwrite_partitions(totals.select("booking_date", revenue, "bookings"), self.out, ["booking_date"])
        self.payments.store.add(new, batch_id)
        self.days.add(deltas, batch_id)
        totals.unpersist()
        deltas.unpersist()


def daily_revenue_of(payments: DataFrame) -> DataFrame:
    """Revenue per day of payments with a date."""
    return (
        payments.filter(F.col("payment_date").isNotNull())
        .groupBy(F.to_date("payment_date").alias("booking_date"))
        .agg(money_sum("amount").alias("daily_revenue"), F.count(F.lit(1)).alias("bookings"))
    )
