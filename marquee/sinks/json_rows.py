"""Result rows as the JSON documents the dashboard receives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _wire(field: T.StructField) -> Column:
    """Exact numbers travel as text, dates and times as UTC instants, the rest as is."""
    value = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.DecimalType, T.LongType)):
        value = value.cast("string")
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = F.date_format(value.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return value.alias(field.name)


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    row = F.struct(*[_wire(f) for f in df.schema.fields])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias(name))
