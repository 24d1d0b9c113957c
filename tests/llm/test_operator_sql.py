"""Queries against their DuckDB SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from marquee.llm.oracles import ORACLES
from marquee.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, name, SMALL)


def test_quality_with_certified_cutoffs(spark):
    """On enough labels cutoffs are certified and decide, in the query as in its SQL."""
    found = compare(spark, "op2_quality", "/root/testdata/sf0.1")
    assert any(not r.kept and not r.base_failed for r in found)


def compare(spark, name, folder):
    duck = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = duck.execute(ORACLES[name])
    columns = sorted(c[0] for c in result.description)
    place = {c[0]: i for i, c in enumerate(result.description)}
    expected = sorted(([row[place[c]] for c in columns] for row in result.fetchall()), key=repr)
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == columns
    rows = df.collect()
    found = sorted(([row[c] for c in columns] for row in rows), key=repr)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        for x, y in zip(a, b):
            assert math.isclose(x, y, rel_tol=1e-12) if isinstance(x, float) and y is not None else x == y
    return rows
