"""Keys and indexes from a header and its data."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LoadConfig
from ..functions.typesystem import DATE_GROUP, FLOAT_GROUP, INT_GROUP, TEXT_GROUP
from ..header import Header, surrogate_definition
from .profile import ColumnStats, quoted

ID_NAME = re.compile(r"(?:^|_)id$", re.IGNORECASE)
COMBINATIONS_AT_ONCE = 8  # combinations tested by one job


def is_combination_unique(df: DataFrame, columns: Sequence[str]) -> bool:
    return first_unique(df, [list(columns)]) is not None


def combination_counts(df: DataFrame, combos: Sequence[Sequence[str]]) -> DataFrame:
    """One row for each combination that is not unique on its first repeated group: combo (number), none if all are unique.

    Each combination is one aggregation on its own columns; nulls count as values.
    """
    parts = [
        df.groupBy(*[quoted(c) for c in combo]).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).select(
            F.lit(i).alias("combo"), F.lit(",".join(combo)).alias("columns"), "groups", "most"
        )
        for i, combo in enumerate(combos)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def first_unique(df: DataFrame, combos: Sequence[Sequence[str]]) -> list[str] | None:
    """First combination, in the given order, whose values are different in all rows."""
    for at in range(0, len(combos), COMBINATIONS_AT_ONCE):
        part = combos[at : at + COMBINATIONS_AT_ONCE]
        unique = sorted(r["combo"] for r in combination_counts(df, part).collect() if r["most"] <= 1)
        if unique:
            return list(part[unique[0]])
    return None


def _search(df: DataFrame, rows: int, candidates: list[str], required: list[str], stats: dict[str, ColumnStats], most: int) -> list[str] | None:
    """Smallest combination that is a key; combinations whose distinct counts multiply to too few are not tested."""
    for size in range(1, most + 1):
        combos: list[list[str]] = []
        for chosen in combinations(candidates, size):
            combo = list(dict.fromkeys([*required, *chosen]))
            # Estimates may be low by a few standard errors: only a clear shortfall rules a combination out.
            room = prod(stats[c].distinct * (1 if stats[c].exact else 1.2) for c in combo if c in stats)
            if room >= rows and combo not in combos:
                combos.append(combo)
        if combos and (found := first_unique(df, combos)):
            return found
    return None


def predict_indexes(header: Header, df: DataFrame | None, stats: dict[str, ColumnStats], rows: int, config: LoadConfig, primary_key: Sequence[str] = (), extend: bool = False) -> Header:
    """Header with ``index`` and ``primary`` set.

    Dates and (nearly) unique columns get indexes.  The key is what the caller
    asks for (with more columns if that is not unique and ``extend`` is set); else a NOT NULL unique column, best one named id, then an integer,
    then the shortest name; else the smallest combination of nearly unique or
    categorical NOT NULL columns, with dates as a last resort.
    """
    out = header.copy()
    single: list[str] = []
    parts: list[str] = []
    required: list[str] = []
    for name, c in out.items():
        asked = name in primary_key
        s = stats.get(name)
        size = max(c.length, s.bytes if s else 0) or 255
        long_text = c.type in TEXT_GROUP and c.type != "varchar"
        if not asked and (long_text or size >= config.max_key_length or c.decimal or c.type in FLOAT_GROUP):
            continue
        if c.type in DATE_GROUP or c.unique or c.pseudounique:
            out.change(name, index=True)
        if asked:
            out.change(name, primary=True)
            required.append(name)
        elif c.unique and not c.allow_null:
            single.append(name)
        elif (c.pseudounique or c.categorical) and not c.allow_null:
            parts.append(name)
    if required and (not extend or df is None or not rows or is_combination_unique(df, required)):
        return out
    if single:
        key = next((n for n in single if ID_NAME.search(n)), None) or next((n for n in single if out[n].type in INT_GROUP), None) or min(single, key=len)
        out.change(key, primary=True)
        return out
    if df is None or not rows:
        return out
    dates = [n for n, c in out.items() if c.type in DATE_GROUP and not c.allow_null and n not in parts]
    found = _search(df, rows, parts, required, stats, config.max_composite_key_columns)
    if found is None and dates:
        found = _search(df, rows, [*parts, *dates], required, stats, config.max_composite_key_columns)
    for n in found or ():
        out.change(n, primary=True)
    return out


def apply_surrogate(header: Header, existing: Header | None, config: LoadConfig) -> Header:
    """Add a surrogate key where a new table has no natural one; keep one that exists."""
    if not config.surrogate_key:
        return header
    if existing:
        name = next((n for n, c in existing.items() if c.auto_increment and c.primary), None)
        if name is None:
            return header
        plain = {n: c.with_(primary=False) for n, c in header.items() if n != name}
        return Header({**plain, name: surrogate_definition()})
    if header.primary_keys:
        return header
    name = config.surrogate_key_column
    if name in header:
        raise ValueError(f"surrogate column {name!r} is a column of the data; set surrogate_key_column")
    return Header({name: surrogate_definition(), **header})
