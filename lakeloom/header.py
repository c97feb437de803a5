"""Column definitions and table headers: the source of truth about a table's schema (§1.2, I1, I21-I23, R7)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import types as T

from .functions.typesystem import local_type, spark_type

METADATA_KEY = "lakeloom"


@dataclass(frozen=True)
class ColumnDef:
    type: str | None = None
    length: int = 0
    decimal: int = 0
    allow_null: bool = False
    unique: bool = False
    unique_name: str | None = None
    index: bool = False
    pseudounique: bool = False
    categorical: bool = False
    single_value: bool = False
    primary: bool = False
    auto_increment: bool = False
    default: Any = None
    ddl_default: str | None = None
    calculated: bool = False
    updated_calculated: bool = False
    calculated_default: Any = None
    previous_type: str | None = None
    table_name: str | None = None

    def with_(self, **changes: Any) -> ColumnDef:
        return replace(self, **changes)

    @property
    def data_type(self) -> T.DataType:
        return spark_type(self.type or "varchar", self.length, self.decimal)

    def as_dict(self) -> dict[str, Any]:
        """Only what differs from a plain column, so that stored headers stay readable."""
        plain = ColumnDef()
        return {k: v for k, v in asdict(self).items() if v != getattr(plain, k)}


class Header(dict):
    """Ordered column name -> ColumnDef."""

    def __init__(self, columns: Mapping[str, ColumnDef] | Iterable[tuple[str, ColumnDef]] = ()):
        super().__init__(columns)

    @property
    def primary_keys(self) -> list[str]:
        return [n for n, c in self.items() if c.primary]

    @property
    def unique_columns(self) -> list[str]:
        return [n for n, c in self.items() if c.unique and not c.primary]

    @property
    def unique_groups(self) -> list[list[str]]:
        """Columns of each unique constraint: single ones, and those that share the name of one."""
        named: dict[str, list[str]] = {}
        for n, c in self.items():
            if c.unique and c.unique_name:
                named.setdefault(c.unique_name, []).append(n)
        several = [g for g in named.values() if len(g) > 1]
        return [[n] for n in self.unique_columns if not any(n in g for g in several)] + several

    def updatable(self) -> list[str]:
        """Columns that an update overwrites: not keys, not values calculated once."""
        return [n for n, c in self.items() if not c.primary and (not c.calculated or c.updated_calculated)]

    def change(self, name: str, **changes: Any) -> None:
        self[name] = self[name].with_(**changes)

    def copy(self) -> Header:
        return Header(self)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, c.data_type, True, {METADATA_KEY: json.dumps(c.as_dict(), sort_keys=True)}) for n, c in self.items()])

    def as_json(self) -> dict[str, dict]:
        return {n: c.as_dict() for n, c in self.items()}

    @staticmethod
    def from_json(data: Mapping[str, Mapping[str, Any]]) -> Header:
        return Header((n, ColumnDef(**d)) for n, d in data.items())

    @staticmethod
    def from_struct(schema: T.StructType) -> Header:
        """Header of a frame: what its fields carry, else what their types say."""
        out = Header()
        for f in schema.fields:
            if METADATA_KEY in (f.metadata or {}):
                out[f.name] = ColumnDef(**json.loads(f.metadata[METADATA_KEY]))
                continue
            size = (f.dataType.precision, f.dataType.scale) if isinstance(f.dataType, T.DecimalType) else (0, 0)
            out[f.name] = ColumnDef(local_type(f.dataType), *size, allow_null=f.nullable)
        return out

    def checksum(self) -> str:
        return hashlib.sha256(stable_json(self.as_json()).encode()).hexdigest()


def stable_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def is_header(value: object) -> bool:
    return isinstance(value, Mapping) and bool(value) and all(isinstance(c, ColumnDef) and c.type is not None for c in value.values())


def surrogate_definition() -> ColumnDef:
    return ColumnDef("bigint", primary=True, auto_increment=True)


def overlay(inferred: Header, given: Mapping[str, ColumnDef]) -> Header:
    """Given definitions win; inferred ones fill what is not given."""
    return Header({**inferred, **given})


def covers(header: Mapping[str, ColumnDef], columns: Iterable[str]) -> bool:
    return all(c in header for c in columns)


def normalize_name(name: str) -> str:
    """Lower case letters and digits only, for comparing names."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def constraint_name(table: str, column: str, kind: str = "unique", limit: int = 63) -> str:
    """Name of a constraint within the limit of bytes; a long one ends in part of its digest."""
    base = re.sub(r"[^A-Za-z0-9_]", "_", f"{table}_{column}_{kind}")
    if len(base.encode()) <= limit:
        return base
    tail = hashlib.md5(base.encode()).hexdigest()[:6]
    return f"{base[: limit - 7]}_{tail}"
