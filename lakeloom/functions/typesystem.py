"""Inference types: groups, the widening join, and their Spark types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

# The type groups, each in widening order.
INT_GROUP = ("boolean", "binary", "tinyint", "smallint", "int", "numeric", "bigint")
FLOAT_GROUP = ("decimal", "double", "exponent")
TEXT_GROUP = ("varchar", "text", "mediumtext", "longtext")
JSON_GROUP = ("json",)
DATE_GROUP = ("date", "time", "datetime", "datetimetz", "timestamp", "timestamptz")
ALL_TYPES = INT_GROUP + FLOAT_GROUP + TEXT_GROUP + JSON_GROUP + DATE_GROUP
CODE = {t: i for i, t in enumerate(ALL_TYPES)}  # bit of a type in a mask
NOT_CATEGORICAL = ("boolean", "tinyint", "smallint", "binary", "datetimetz", "datetime")

NUMBER_CHAIN = INT_GROUP + FLOAT_GROUP


def is_integer(t: str) -> bool:
    """Whole numbers of a fixed width: neither boolean nor binary, nor ``numeric``, which has a scale."""
    return t in INT_GROUP and t not in ("boolean", "binary", "numeric")


def is_floating(t: str) -> bool:
    return t in FLOAT_GROUP or t == "numeric"


def is_numeric(t: str) -> bool:
    return is_integer(t) or is_floating(t)


def is_text(t: str) -> bool:
    return t in TEXT_GROUP or t in JSON_GROUP


def is_boolean(t: str) -> bool:
    return t == "boolean"


def is_date(t: str) -> bool:
    return t in ("date", "datetime", "datetimetz")


def is_time(t: str) -> bool:
    return t == "time"


def join_types(a: str, b: str) -> str:
    """Least type that holds both: a commutative, associative, idempotent operation."""
    if a == b:
        return a
    if a in NUMBER_CHAIN and b in NUMBER_CHAIN:
        return NUMBER_CHAIN[max(NUMBER_CHAIN.index(a), NUMBER_CHAIN.index(b))]
    if a in DATE_GROUP and b in DATE_GROUP:
        return "datetimetz" if "datetimetz" in (a, b) else "datetime"
    tiers = [TEXT_GROUP.index(t) for t in (a, b) if t in TEXT_GROUP]
    return TEXT_GROUP[max(tiers, default=0)]


def collate(types: Iterable[str | None]) -> str:
    """Join of any number of types, nulls ignored; text for none at all."""
    out: str | None = None
    for t in types:
        if t is not None:
            out = t if out is None else join_types(out, t)
    return out or "varchar"


def from_mask(mask: int | None) -> list[str]:
    return [t for t, i in CODE.items() if mask and mask >> i & 1]


def text_tier(chars: int) -> str:
    """Tier by characters, the first bound that holds."""
    for bound, tier in ((6553, "varchar"), (65535, "text"), (16777215, "mediumtext"), (4294967295, "longtext")):
        if chars < bound:
            return tier
    raise ValueError("data_too_long")


def merge_lengths(a: str | None, b: str | None) -> tuple[int, int]:
    """Element-wise maximum of two ``"p"`` or ``"p,s"`` lengths."""
    one, two = parse_length(a), parse_length(b)
    return max(one[0], two[0]), max(one[1], two[1])


def parse_length(text: str | None) -> tuple[int, int]:
    parts = [p.strip() for p in str(text or "").split(",")]
    numbers = [int(p) if p.isdigit() else 0 for p in parts][:2]
    return (numbers + [0, 0])[0], (numbers + [0, 0])[1]


def spark_type(local: str, length: int = 0, scale: int = 0) -> T.DataType:
    """Storage type.  Decimals beyond 38 digits are kept as text."""
    if local in ("decimal", "numeric"):
        precision = max(length, scale, 1) if length else 38
        return T.StringType() if precision > 38 or scale > 38 else T.DecimalType(precision, scale)
    simple = {
        "boolean": T.BooleanType(),
        "binary": T.BinaryType(),
        "tinyint": T.ByteType(),
        "smallint": T.ShortType(),
        "int": T.IntegerType(),
        "bigint": T.LongType(),
        "double": T.DoubleType(),
        "exponent": T.DoubleType(),
        "date": T.DateType(),
        "datetime": T.TimestampNTZType(),
        "timestamp": T.TimestampNTZType(),
        "datetimetz": T.TimestampType(),
        "timestamptz": T.TimestampType(),
    }
    return simple.get(local, T.StringType())


def local_type(kind: T.DataType) -> str:
    """Inference type of a Spark column that has no header of its own (K1)."""
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return "json"
    names = {
        "boolean": "boolean", "binary": "binary", "byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint",
        "float": "double", "double": "double", "date": "date", "timestamp_ntz": "datetime", "timestamp": "datetimetz",
    }
    return names.get(kind.typeName(), "varchar")
