"""What tests share besides fixtures: the folder of the smallest tables, rows in one order."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
