"""Stored form of values by column type, and other value texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LoadConfig
from . import dates
from .numbers import js_number_text, normalize_number, round_half_up
from .typesystem import DATE_GROUP, NUMBER_CHAIN, spark_type

# Boolean words, by where they are read.
STORE_TRUE, STORE_FALSE = ("1", "true", "t", "yes"), ("0", "false", "f", "no")
WIDEN_TRUE, WIDEN_FALSE = ("true", "t", "yes", "y", "1", "on"), ("false", "f", "no", "n", "0", "off")
HINT_WORDS = ("0", "1", "true", "false", "", "null")


def boolean_of(text: Column, widen: bool = False) -> Column:
    """True or false of a boolean word, null for others."""
    s = F.lower(F.trim(text))
    yes, no = (WIDEN_TRUE, WIDEN_FALSE) if widen else (STORE_TRUE, STORE_FALSE)
    return F.when(s.isin(*yes), True).when(s.isin(*no), False)


def outside_hint(text: Column) -> Column:
    """Whether a value may not stand in a column declared boolean."""
    return text.isNotNull() & ~F.lower(F.trim(text)).isin(*HINT_WORDS)


def sanitize(text: Column) -> Column:
    """Text without NUL; bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(F.replace(text, F.lit("\u0000"), F.lit("")))


def as_text(column: Column, kind: T.DataType) -> Column:
    """Any cell as text: JSON for nested values, numbers as their source prints them."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(js_number_text(column.cast("double")), column.cast("string"))
    if isinstance(kind, T.DecimalType):
        return F.regexp_replace(F.regexp_replace(column.cast("string"), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
    return column.cast("string")


def copy_text(text: Column) -> Column:
    """One value in COPY text form: ``\\N`` for null; backslash, tab, line feed and return escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, name in (("\t", "t"), ("\n", "n"), ("\r", "r")):
        out = F.replace(out, F.lit(char), F.lit("\\" + name))
    return F.coalesce(out, F.lit("\\N"))


def copy_line(columns: list[Column]) -> Column:
    return F.concat_ws("\t", *[copy_text(c) for c in columns])


def number_text(text: Column, config: LoadConfig, scale: int | None = None) -> Column:
    """Plain rounded number text of a number-like value; the text itself where it is none."""
    plain = F.coalesce(normalize_number(text, config.separators), text)
    return round_half_up(plain, config.scale_cap if scale is None else scale)


def json_text(text: Column) -> Column:
    """JSON re-written without white space; a text that does not parse stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def canonical_text(column: Column, kind: T.DataType, local: str, config: LoadConfig) -> Column:
    """Text by which values of one column are told apart: equal values in different spelling coincide."""
    text = as_text(column, kind)
    if local in NUMBER_CHAIN and local != "boolean":
        return number_text(text, config)
    if local == "boolean":
        return F.coalesce(boolean_of(text).cast("int").cast("string"), text)
    if local == "json":
        return json_text(text)
    return text


def store_value(column: Column, kind: T.DataType, local: str, length: int, scale: int, config: LoadConfig) -> Column:
    """Typed value of a cell for a column of type ``local``; null if absent or not convertible.

    Values that convert to null although present are what the load rejects.
    """
    target = spark_type(local, length, scale)
    if kind == target and not isinstance(kind, T.StringType):
        return column
    text = as_text(column, kind)
    present = F.when(~text.isin("", "null"), text)
    if local == "boolean":
        return column.cast("boolean") if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else boolean_of(present)
    if local == "json":
        return json_text(present)
    if local in NUMBER_CHAIN and local != "binary":
        if isinstance(kind, T.BooleanType):
            return column.cast("int").try_cast(target)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return column.try_cast(target)
        if isinstance(target, T.DoubleType):
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                return column.cast("double")
            return F.coalesce(normalize_number(present, config.separators), present).try_cast("double")
        wanted = scale if isinstance(target, T.DecimalType) else 0
        return number_text(present, config, wanted).try_cast(target) if not isinstance(target, T.StringType) else number_text(present, config)
    if local in DATE_GROUP and local != "time":
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), column.cast("timestamp_ntz")) if isinstance(kind, T.TimestampType) else column.cast("timestamp_ntz")
            clock = utc
        else:
            clock = dates.to_date(present, config.date_order).cast("timestamp_ntz") if local == "date" else dates.to_datetime(present, config.source_time_zone, config.date_order)
        if config.truncate_fractions:
            clock = F.date_trunc("second", clock).cast("timestamp_ntz")
        if isinstance(target, T.TimestampType):
            return F.convert_timezone(F.lit("UTC"), F.current_timezone(), clock).cast("timestamp")
        return clock.cast(target)
    if local == "time":
        return dates.to_time_text(present)
    if isinstance(target, T.BinaryType):
        return present.cast("binary")
    return sanitize(present) if config.sanitize_invalid_chars else present
