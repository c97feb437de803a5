"""Projection of stored rows to a changed header (§2.11, D3, D10, D23)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..functions.typesystem import DATE_GROUP, FLOAT_GROUP, INT_GROUP, JSON_GROUP, TEXT_GROUP
from ..functions.values import as_text, boolean_of
from ..header import ColumnDef, Header
from ..plans.profile import quoted


def convert(column: Column, old: str, new: ColumnDef, kind: T.DataType) -> Column:
    """A stored value of local type ``old`` as a value of ``new``; null where it cannot be one."""
    target = new.data_type
    to = new.type or "varchar"
    numbers = INT_GROUP[1:] + FLOAT_GROUP
    texts = TEXT_GROUP + JSON_GROUP
    if old == to and kind == target:
        return column
    if old == "boolean" and to in numbers:
        return column.cast("int").cast(target)
    if old in numbers and to == "boolean":
        return column == 1
    if old in texts and to == "boolean":
        return boolean_of(column, widen=True)
    if old in FLOAT_GROUP and to in INT_GROUP:
        return F.round(column).try_cast(target)
    if old in numbers and to in numbers:
        return column.try_cast(target)
    if old in texts and to in numbers:
        return F.nullif(column, F.lit("")).try_cast(target)
    if old in texts and to in DATE_GROUP:
        text = F.nullif(column, F.lit(""))
        if to == "date":
            return dates.to_date(text)
        return dates.to_time_text(text) if to == "time" else dates.to_datetime(text).cast(target)
    if old in DATE_GROUP and to in texts:
        return column if old == "time" else F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    if to in texts:
        return as_text(column, kind)
    return column.try_cast(target)


def project(df: DataFrame, old: Header, new: Header, renames: Mapping[str, str] = {}, fill: Mapping[str, Column] = {}) -> DataFrame:
    """Rows under ``old`` as rows under ``new``: renamed, converted, with added columns null or filled."""
    before = {v: k for k, v in renames.items()}
    out = []
    for name, c in new.items():
        was = before.get(name, name)
        if was in df.columns:
            kind = df.schema[was].dataType
            value = convert(quoted(was), old[was].type or "varchar" if was in old else "varchar", c, kind)
        else:
            default = c.calculated_default if c.calculated_default is not None else c.default
            value = fill.get(name, F.lit(default) if not isinstance(default, str) or default != "run_time" else F.lit(None))
        out.append(value.cast(c.data_type).alias(name))
    return df.select(*out)
