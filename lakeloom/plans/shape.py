"""Row sizes, vertical splits, column semantics and time stamps."""

from __future__ import annotations

import math
import re

from ..config import LoadConfig
from ..functions.typesystem import is_boolean, is_date, is_numeric
from ..header import ColumnDef, Header, normalize_name
from .keys import ID_NAME

MAX_COLUMNS = 100
NEARLY = 0.8
ROW_OVERHEAD, NULL_BYTES, INDEX_BYTES = 20, 1, 8
# Bytes of a column by type; varchar and decimals depend on their size.
TYPE_BYTES = {
    "boolean": 1, "binary": 1, "tinyint": 1, "smallint": 2, "int": 4, "numeric": 4, "bigint": 8, "date": 3, "time": 3, "datetime": 8, "datetimetz": 8,
    "text": 2, "mediumtext": 3, "longtext": 4, "json": 4,
}
VARCHAR_DEFAULT, DECIMAL_DEFAULT = 255, 10

# Names under which data may already carry its own time stamps.
STAMP_NAMES = {
    "created": (
        "dwh_created_at", "created_at", "create_at", "created_date", "create_date", "creation_time", "createdon", "record_created", "inserted_at",
        "creation_date", "createdtimestamp", "created_ts", "createddatetime", "createdutc", "creationtimestamp", "insertedutc", "inserteddate",
        "insertedtime", "createddateutc", "createdondate", "row_created_at", "inserted_timestamp", "created_iso", "created_time_utc",
    ),
    "modified": (
        "dwh_modified_at", "modified_at", "modify_at", "modified_date", "update_date", "updatedon", "last_modified", "last_update", "record_updated",
        "changed_at", "updated_timestamp", "modified_ts", "updateddatetime", "lastmodified", "modifiedutc", "modifieddateutc", "updateddateutc",
        "lastupdateutc", "updatedondate", "row_modified_at", "updatetime", "last_updated_at", "modified_time_utc",
    ),
    "loaded": (
        "dwh_loaded_at", "dwh_loaded_date", "data_warehouse_loaded_at", "etl_loaded_at", "data_loaded_at", "extract_timestamp", "ingestion_time",
        "etl_timestamp", "dw_timestamp", "loadedat", "load_timestamp", "ingested_at", "load_date", "dwloadtimestamp", "sync_timestamp", "imported_at",
        "import_timestamp", "staging_loaded_at", "data_loaded_time", "record_loaded_at",
    ),
}
STAMP_COLUMN = {"created": "dwh_created_at", "modified": "dwh_modified_at", "loaded": "dwh_loaded_at"}


def row_bytes(header: Header, config: LoadConfig) -> int:
    total = ROW_OVERHEAD
    for c in header.values():
        kind = c.type or "varchar"
        if kind == "varchar":
            size = (c.length or VARCHAR_DEFAULT) * config.profile.bytes_per_char
        elif kind in ("decimal", "double", "exponent"):
            size = math.ceil(c.decimal / 2) + 1 if c.decimal else DECIMAL_DEFAULT
        else:
            size = TYPE_BYTES.get(kind, 0)
        total += size + (NULL_BYTES if c.allow_null else 0) + (INDEX_BYTES if c.primary or c.unique or c.index else 0)
    return total


def too_wide(header: Header, config: LoadConfig) -> bool:
    return row_bytes(header, config) > config.profile.max_row_bytes or len(header) >= MAX_COLUMNS


def nearly_full(header: Header, config: LoadConfig) -> bool:
    return row_bytes(header, config) > NEARLY * config.profile.max_row_bytes or len(header) >= MAX_COLUMNS


def part_name(table: str, number: int) -> str:
    return f"{table}__part_{number:03d}"


def next_table_name(name: str) -> str:
    m = re.fullmatch(r"(.*)__part_([0-9]+)", name, re.DOTALL)
    return part_name(m[1], int(m[2]) + 1) if m else part_name(name, 1)


def split_parts(table: str, header: Header, placed: dict[str, Header], config: LoadConfig) -> dict[str, Header]:
    """Headers of the parts of a wide table.

    A column stays in every part that already has it; keys go to each part; new
    columns fill the last part until it is nearly full, then the next.
    """
    keys = {n: c for n, c in header.items() if c.primary}
    parts: dict[str, Header] = {}
    for name, old in sorted(placed.items()):
        own = Header({**keys, **{n: header[n] for n in old if n in header}})
        if len(own) > len(keys) or not header.keys() - keys.keys():
            parts[name] = own
    known = {n for p in parts.values() for n in p}
    name = max(parts, default=part_name(table, 1))
    parts.setdefault(name, Header(keys))
    for n, c in header.items():
        if n in known or n in keys:
            continue
        grown = Header({**parts[name], n: c})
        if nearly_full(grown, config) and len(parts[name]) > len(keys):
            name = next_table_name(name)
            grown = Header({**keys, n: c})
        parts[name] = grown
    return parts


def history_name(table: str, config: LoadConfig) -> str:
    return table + config.history_table_suffix


def true_name(name: str, config: LoadConfig) -> str:
    """Table behind a staging or history name."""
    name = re.sub(rf"\A{re.escape(config.staging_prefix)}(.*)__[0-9a-f]{{8}}\Z", r"\1", name)
    return name.removesuffix(config.history_table_suffix)


def semantics(header: Header, others: list[str] | None = None) -> list[dict]:
    """Role, cardinality, meaning and possible reference of every column."""
    out = []
    for name, c in header.items():
        role = "primary" if c.primary else "unique" if c.unique else "index" if c.index else "none"
        levels = (("single", c.single_value), ("unique", c.unique), ("pseudounique", c.pseudounique), ("categorical", c.categorical))
        cardinality = next((k for k, on in levels if on), "normal")
        kind = c.type or ""
        hints = (
            ("identifier", role in ("primary", "unique") or bool(ID_NAME.search(name))), ("flag", is_boolean(kind)), ("time", is_date(kind)),
            ("dimension", cardinality in ("categorical", "single")), ("measure", is_numeric(kind)),
        )
        entity = re.sub(r"_id\Z", "", name, flags=re.IGNORECASE) if re.search(r"._id\Z", name, re.IGNORECASE) else None
        forms = {entity.lower() + s for s in ("", "s", "es")} if entity else set()
        out.append(
            {
                "column": name, "type": c.type, "role": role, "nullable": c.allow_null, "cardinality": cardinality,
                "hint": next((h for h, on in hints if on), "attribute"), "references": entity,
                "matched_table": next((t for t in others or [] if t.lower() in forms), None),
            }
        )
    return out


def add_stamps(header: Header) -> Header:
    """Header with the load's own time stamps, but for those the data brings under a known name."""
    out = header.copy()
    names = {normalize_name(n) for n in header}
    for kind, known in STAMP_NAMES.items():
        own = STAMP_COLUMN[kind]
        if own in out or names & {normalize_name(n) for n in known}:
            continue
        out[own] = ColumnDef("datetime", calculated=True, updated_calculated=kind != "created", calculated_default="run_time")
    return out
