"""Splitting a batch in rows that a table takes and rows that it refuses."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.typing import is_nullish
from ..functions.values import as_text
from ..header import Header
from ..plans.profile import TEXT, quoted

REJECT_COLUMNS = ("target_table", "rejected_at", "error_message", "raw_data")


def reason_of(raw: DataFrame, typed: Mapping[str, Column], header: Header, checks: Mapping[str, str]) -> Column:
    """First reason why a row is refused, null if it is not.

    A value that is present but has no form in the column's type, a null in a
    NOT NULL column that nothing fills, a text too long, or a failed check.
    """
    reasons = []
    for name, c in header.items():
        if name not in raw.columns:
            continue
        kind = raw.schema[name].dataType
        column, value = quoted(name), typed[name]
        there = ~is_nullish(column) & column.isNotNull() if isinstance(kind, TEXT) else column.isNotNull()
        reasons.append(F.when(there & value.isNull(), f"{name}: not a {c.type}"))
        if not c.allow_null and not c.auto_increment and c.default is None and not c.calculated:
            reasons.append(F.when(value.isNull(), f"{name}: must not be null"))
        if c.type == "varchar" and c.length:
            reasons.append(F.when(F.length(value) > c.length, f"{name}: longer than {c.length}"))
    for name, condition in checks.items():
        reasons.append(F.when(~F.coalesce(F.expr(condition), F.lit(True)), f"check {name} fails"))
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def split_rows(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``error_message``), two projections of one scan each."""
    marked = df.withColumn("error_message", reason)
    return marked.filter(F.col("error_message").isNull()).drop("error_message"), marked.filter(F.col("error_message").isNotNull())


def reject_rows(rejected: DataFrame, table: str, at: Column) -> DataFrame:
    """Rows of the rejects table: target_table, rejected_at, error_message and the row as JSON."""
    raw = [as_text(quoted(c), rejected.schema[c].dataType).alias(c) for c in rejected.columns if c != "error_message"]
    return rejected.select(F.lit(table).alias("target_table"), at.alias("rejected_at"), "error_message", F.to_json(F.struct(*raw)).alias("raw_data"))
