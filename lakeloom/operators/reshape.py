"""Nested extraction and vertical splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..header import Header
from ..plans.profile import quoted


def parse_json_column(df: DataFrame, name: str, schema: str | T.DataType | None = None) -> DataFrame:
    """A JSON text column as nested values.  Without ``schema`` it is inferred from all rows by one aggregation."""
    if schema is None:
        found = df.select(F.schema_of_variant_agg(F.try_parse_json(quoted(name)))).first()[0]
        if found is None or found == "VOID":
            return df
        schema = found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    return df.withColumn(name, F.from_json(quoted(name), schema))


def extract_nested(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame | None:
    """Rows of a child table from a nested column: one for an object, one for each object of an array.

    The parent's keys are added and win over child fields of the same name.
    Nulls and arrays without objects give no row; None if the column is not nested.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType)):
        rows = df.select(F.explode(quoted(name)).alias("_child"), *[quoted(k) for k in keys])
        kind = kind.elementType
    elif isinstance(kind, (T.StructType, T.MapType)):
        rows = df.select(quoted(name).alias("_child"), *[quoted(k) for k in keys])
    else:
        return None
    rows = rows.filter("_child is not null")
    if isinstance(kind, T.MapType):
        return rows.select(F.to_json("_child").alias("value"), *[quoted(k) for k in keys])
    fields: list[Column] = [F.col("_child")[f.name].alias(f.name) for f in kind.fields if f.name not in keys]
    return rows.select(*fields, *[quoted(k) for k in keys])


def extract_values(df: DataFrame, name: str, keys: Sequence[str], position: str = "position", value: str = "value") -> DataFrame:
    """One row for each element of an array of plain values, with its place."""
    return df.select(*[quoted(k) for k in keys], F.posexplode(quoted(name)).alias(position, value))


def split_columns(df: DataFrame, parts: Mapping[str, Header]) -> dict[str, DataFrame]:
    """The projection of each part; parts without a column of the data are left out."""
    out = {}
    for table, header in parts.items():
        columns = [c for c in header if c in df.columns]
        if any(not header[c].primary for c in columns):
            out[table] = df.select(*[quoted(c) for c in columns])
    return out
