"""What the operators share: session settings, tables, results kept in the shared folder."""

from __future__ import annotations

import gc
import sys
import uuid
from collections.abc import Callable, Iterable
from types import ModuleType
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, ensure_checkpoint_dir
from ..sinks.files import remove

#: Characters of a word (fixed by the contract of the queries): all but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes an Arrow batch holds at most: texts may be long, and both sides hold a batch. A
#: longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20

#: Paths that ``store`` wrote in this session and that nobody has deleted yet.
STORED: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """The library's session settings, and Arrow batches small enough for long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back.

    Cuts the lineage, so that lost executors cost no recomputation of what came before, gives
    the planner the real size, and fixes rows that later steps read more than once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, since: int, but: Iterable[str] = ()) -> None:
    """Delete the tables stored since there were ``since`` of them in STORED, except ``but``."""
    kept = set(but)
    for path in STORED[since:]:
        if path not in kept:
            remove(spark, path)
    STORED[since:] = [path for path in STORED[since:] if path in kept]


def words(text: Column) -> Column:
    """The words of a text in order, an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def looked_up(values: dict[Any, int], key: Column) -> Column:
    """The long that a few values have by ``key``, null for others: a map in the plan, so that no
    row is moved to meet its value."""
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), key).cast("long") if pairs else F.lit(None).cast("long")


#: Bits of a hash that one count looks at when the lowest hashes are searched.
REACH_BITS = 12


def lowest_hashes(hashed: DataFrame, group: str, n: int) -> dict[Any, int]:
    """Of each group of ``hashed`` (group, hash long) the n-th smallest different hash, or the
    greatest if there are fewer; null groups are left out.

    Counts of hashes by their leading bits close in on it, so no task ranks a group. A step sends
    at most 2^REACH_BITS counts of each group to the driver; the last one ranks the few hashes
    that share twice that many bits.
    """
    rows = hashed.where(F.col(group).isNotNull()).groupBy(group, "hash").agg(F.lit(1).alias("one"))
    rows = store(rows.select(F.col(group).alias("of"), "hash"), "hashes")
    cut: dict[Any, tuple[int, int]] = {}  # leading bits of the hash looked for, and how many are below

    def narrow(rows: DataFrame, bits: int) -> None:
        lead = F.shiftright("hash", 64 - bits).alias("lead")
        counts: dict[Any, list[tuple[int, int]]] = {}
        for row in rows.groupBy("of", lead).agg(F.count("*").alias("n")).collect():
            counts.setdefault(row["of"], []).append((row["lead"], row["n"]))
        for key, found in counts.items():
            below = cut[key][1] if key in cut else 0
            for lead, number in sorted(found):
                cut[key] = lead, below
                if below + number >= n:
                    break
                below += number

    def inside(bits: int) -> DataFrame:
        return rows.where(F.shiftright("hash", 64 - bits) == looked_up({k: c[0] for k, c in cut.items()}, F.col("of")))

    narrow(rows, REACH_BITS)
    if not cut:
        return {}
    narrow(inside(REACH_BITS), 2 * REACH_BITS)
    last: dict[Any, list[int]] = {}
    for row in inside(2 * REACH_BITS).collect():
        last.setdefault(row["of"], []).append(row["hash"])
    return {key: sorted(found)[: n - cut[key][1]][-1] for key, found in last.items()}


def held(made_from: str, make: Callable[[], Any]) -> Any:
    """What a worker process keeps between tasks, made when ``made_from`` is new to it.

    Workers outlive the stages they serve. There is one place for all operators, so the tables
    and memos of one go when another begins. The place is a module of the worker's own, as
    executors need no copy of this package.
    """
    place = sys.modules.setdefault("marquee_worker_state", ModuleType("marquee_worker_state"))
    if getattr(place, "key", None) != made_from:
        place.key = place.value = None
        gc.collect()
        place.value = make()
        place.key = made_from
    return place.value


def share(spark: SparkSession, value: Any, make: Callable[[Any], Any] = lambda value: value) -> Callable[[], Any]:
    """A function that gives, in any task, what ``make`` makes of ``value``, once per worker.

    ``value`` is broadcast; it must have a bound that does not grow with the data.
    """
    name = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: held(name, lambda: make(cloudpickle.loads(sent.value)))


class Memo(dict):
    """Values by key, made when first asked for; of two generations the older is forgotten when
    the younger has ``size`` entries, so what is asked for often stays. Keys longer than
    ``longest`` are not remembered."""

    def __init__(self, make: Callable[[Any], Any], size: int, longest: int | None = None):
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key: Any) -> Any:
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
