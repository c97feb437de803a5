"""Type of single values as column expressions.

The expression is chosen by the column's Spark type: only text goes through the
patterns; other types need a range test at most.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import layouts
from . import patterns as P
from .numbers import normalize_number
from .typesystem import CODE, DATE_GROUP, JSON_GROUP, NUMBER_CHAIN, TEXT_GROUP, local_type


def is_nullish(text: Column) -> Column:
    """Texts that count as absent: empty, ``\\N`` and ``null``."""
    return text.isin("", "\\N", "null")


def integer_width(text: Column) -> Column:
    """Narrowest integer type of plain digits; text beyond 64 bits."""
    return long_width(text.try_cast("bigint"))


def long_width(n: Column) -> Column:
    return (
        F.when(n.between(-128, 127), "tinyint")
        .when(n.between(-32768, 32767), "smallint")
        .when(n.between(-2147483648, 2147483647), "int")
        .when(n.isNotNull(), "bigint")
        .otherwise("varchar")
    )


def text_tier(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 6553, "varchar").when(n < 65535, "text").when(n < 16777215, "mediumtext").otherwise("longtext")


def number_form(text: Column, separators: tuple[str, str] | None = None) -> Column:
    """Plain digits of a text that looks like a number, empty if it turns out malformed, null for other texts."""
    return F.when(text.rlike(P.NUMERIC), F.coalesce(normalize_number(text, separators), F.lit("")))


def text_type(text: Column, separators: tuple[str, str] | None = None, plain: Column | None = None) -> Column:
    """Type of a text.  ``plain`` is its :func:`number_form`, if that is a column already."""

    def number(p: Column) -> Column:
        # A number text is typed after its separators are read; it may turn out malformed.
        return F.when(p == "", "varchar").when(F.contains(p, F.lit(".")), "decimal").otherwise(integer_width(p))

    if plain is None:  # bound to a variable, so that it is worked out once
        numeric = text.rlike(P.NUMERIC)
        typed = F.element_at(F.transform(F.array(number_form(text, separators)), number), 1)
    else:
        numeric, typed = plain.isNotNull(), number(plain)
    json = text.rlike(P.JSON_START) & F.try_parse_json(text).isNotNull()
    return (
        F.when(text.isNull(), None)
        .when(~text.rlike("[0-9]"), F.when(text.rlike(P.BOOLEAN), "boolean").when(json, "json").otherwise(text_tier(text)))
        .when(text.rlike(P.LEADING_ZERO), "varchar")
        .when(numeric, typed)
        .when(text.rlike(P.EXPONENT), "exponent")
        .when(text.rlike(layouts.ZONED), "datetimetz")
        .when(text.rlike(layouts.UNZONED), "datetime")
        .when(text.rlike(layouts.ONLY_DAY), "date")
        .when(text.rlike(layouts.ONLY_CLOCK), "time")
        .when(json, "json")
        .otherwise(text_tier(text))
    )


def double_type(value: Column) -> Column:
    """Doubles are typed by what they print: whole numbers as integers, very large and small ones as exponents."""
    size = F.abs(value)
    exponent = (size >= 1e21) | ((size < 1e-6) & (size > 0))
    whole = value == F.floor(value).cast("double")
    return (
        F.when(value.isNull(), None)
        .when(F.isnan(value) | (size == float("inf")), "varchar")
        .when(exponent, "exponent")
        .when((size >= 1e15) & whole, F.when(size <= 9.2e18, "bigint").otherwise("varchar"))
        .when(whole, long_width(value.try_cast("bigint")))
        .otherwise("decimal")
    )


def value_type(column: Column, kind: T.DataType, separators: tuple[str, str] | None = None) -> Column:
    """Inference type of each value; null where the value is null."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return F.when(~is_nullish(column), text_type(column, separators))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        n = column.cast("long")
        return (
            F.when(n.isNull(), None)
            .when(n.between(-128, 127), "tinyint")
            .when(n.between(-32768, 32767), "smallint")
            .when(n.between(-2147483648, 2147483647), "int")
            .otherwise("bigint")
        )
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return double_type(column.cast("double"))
    if isinstance(kind, T.DecimalType):
        whole = column == F.floor(column)
        return F.when(column.isNull(), None).when(whole, integer_width(F.floor(column).cast("decimal(38,0)").cast("string"))).otherwise("decimal")
    return F.when(column.isNotNull(), local_type(kind))


def collate_mask(mask: Column) -> Column:
    """Join of the types whose bits (:data:`CODE`) are set, as an expression; null for none (T5)."""
    def only(group: tuple[str, ...]) -> Column:
        return mask.bitwiseAND(F.lit(~sum(1 << CODE[t] for t in group))) == 0

    def has(t: str) -> Column:
        return mask.bitwiseAND(F.lit(1 << CODE[t])) != 0

    def widest(group: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(has(t), t) for t in reversed(group)])

    several = F.bit_count(mask) > 1
    dates = F.when(~several, widest(DATE_GROUP)).when(has("datetimetz"), "datetimetz").otherwise("datetime")
    texts = F.coalesce(widest(TEXT_GROUP), F.lit("varchar"))
    return F.when(mask != 0, F.when(only(NUMBER_CHAIN), widest(NUMBER_CHAIN)).when(only(DATE_GROUP), dates).when(only(JSON_GROUP), "json").otherwise(texts))
