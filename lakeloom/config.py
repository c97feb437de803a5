"""Load configuration: every knob that changes behaviour, validated once."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any
from zoneinfo import ZoneInfo

# Separators by named number format.
NUMBER_FORMATS = {"US": (",", "."), "IN": (",", "."), "EU": (".", ",")}


@dataclass(frozen=True)
class Profile:
    """Limits of a target dialect; types themselves are Spark's."""

    name: str
    max_decimal_scale: int
    max_indexes: int
    bytes_per_char: int
    max_row_bytes: int
    identifier_limit: int
    keeps_offset: bool


# The limits of the three dialect profiles.
PROFILES = {
    "pgsql": Profile("pgsql", 16383, 64, 1, 8 * 1024, 63, True),
    "mysql": Profile("mysql", 30, 64, 4, 16 * 1024, 64, False),
    "sqlserver": Profile("sqlserver", 38, 250, 2, 8 * 1024, 128, True),
}


@dataclass(frozen=True)
class LoadConfig:
    dialect: str = "pgsql"
    # inference
    pseudo_unique: float = 0.9
    categorical: float = 0.2
    sampling: float = 0.0
    sampling_minimum: int = 100
    auto_indexing: bool = True
    max_key_length: int = 255
    max_composite_key_columns: int = 4
    max_varchar_length: int = 1024
    decimal_max_length: int | None = None
    decimal_to_varchar: bool = False
    force_string_columns: tuple[str, ...] = ()
    boolean_columns: tuple[str, ...] = ()
    thousands_separator: str | None = None
    decimal_separator: str | None = None
    number_format: str | None = None
    number_format_min_evidence: int = 1
    source_time_zone: str | None = None
    date_order: str = "MDY"
    utf16_lengths: bool = False
    exclude_blank_columns: bool = True
    sanitize_invalid_chars: bool = False
    truncate_fractions: bool = False
    # load
    insert_type: str = "UPDATE"
    on_duplicate: str = "last"
    safe_mode: bool = False
    delete_columns: bool = False
    update_primary_key: bool = False
    drop_unique_constraints: bool = False
    rejected_rows_table: str | None = None
    checks: Mapping[str, str] = field(default_factory=dict)
    max_retries: int = 3
    # shape
    add_timestamps: bool = True
    add_nested: bool = False
    nested_tables: tuple[str, ...] = ()
    auto_split: bool = False
    surrogate_key: bool = False
    surrogate_key_column: str = "_surrogate_id"
    # history and audit
    add_history: bool = False
    history_tables: tuple[str, ...] = ()
    history_table_suffix: str = "__history"
    schema_history: bool = False
    detect_drift: bool = True
    strict_drift_detection: bool = False
    run_audit: bool = False
    use_schema_lock: bool = False
    schema_lock_timeout: float = 30.0
    staging_prefix: str = "_stream__"
    keep_orphaned_staging: bool = False
    # accepted for compatibility; partitions and the columnar writer make them moot (a warning says so)
    use_staging_insert: bool = True
    bulk_load: bool = False
    insert_stack: int = 100
    connection_limit: int = 5
    logger: Any = None

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.dialect in PROFILES, f"unknown dialect {self.dialect!r}")
        need(0 < self.pseudo_unique <= 1, "pseudo_unique must be in (0, 1]")
        need(0 < self.categorical < 1, "categorical must be in (0, 1)")
        need(0 <= self.sampling <= 1, "sampling must be in [0, 1]")
        need(self.sampling_minimum > 0, "sampling_minimum must be positive")
        need(self.max_key_length > 0 and self.max_composite_key_columns > 0, "key limits must be positive")
        need(self.max_varchar_length > 0, "max_varchar_length must be positive")
        need(self.decimal_max_length is None or self.decimal_max_length >= 0, "decimal_max_length must not be negative")
        need(self.insert_type in ("UPDATE", "INSERT"), "insert_type must be UPDATE or INSERT")
        need(self.on_duplicate in ("last", "error"), "on_duplicate must be last or error")
        need(self.date_order in ("MDY", "DMY"), "date_order must be MDY or DMY")
        need(self.number_format is None or self.number_format in NUMBER_FORMATS, "number_format must be US, EU or IN")
        need((self.thousands_separator is None) == (self.decimal_separator is None), "give both separators or neither")
        need(self.thousands_separator is None or self.thousands_separator != self.decimal_separator, "separators must differ")
        need(self.number_format_min_evidence >= 1, "number_format_min_evidence must be 1 or more")
        need(self.schema_lock_timeout > 0 and self.max_retries >= 1 and self.insert_stack > 0, "timeouts, retries and stacks must be positive")
        need(not (self.add_nested and not self.nested_tables), "add_nested needs nested_tables")
        need(not (self.add_history and not self.use_staging_insert), "add_history needs staging")
        clash = self.surrogate_key and (self.add_history or self.add_nested or self.auto_split)
        need(not clash, "surrogate_key does not combine with history, nested tables or splitting")
        both = set(self.force_string_columns) & set(self.boolean_columns)
        need(not both, f"columns forced to text and to boolean: {sorted(both)}")
        if self.source_time_zone is not None:
            try:
                ZoneInfo(self.source_time_zone)
            except Exception as e:
                raise ValueError(f"unknown time zone {self.source_time_zone!r}") from e

    def moot(self) -> list[str]:
        """Settings that were changed and have no effect here."""
        plain = {"use_staging_insert": True, "bulk_load": False, "insert_stack": 100, "connection_limit": 5}
        return [n for n, v in plain.items() if getattr(self, n) != v]

    @property
    def profile(self) -> Profile:
        return PROFILES[self.dialect]

    @property
    def separators(self) -> tuple[str, str] | None:
        """Configured (thousands, decimal): an explicit pair wins over a named format."""
        if self.thousands_separator is not None:
            return self.thousands_separator, self.decimal_separator
        return NUMBER_FORMATS[self.number_format] if self.number_format else None

    @property
    def scale_cap(self) -> int:
        cap = self.profile.max_decimal_scale if self.decimal_max_length is None else self.decimal_max_length
        return min(cap, 38)

    def with_(self, **changes: Any) -> LoadConfig:
        return replace(self, **changes)

    def log(self, level: str, message: str) -> None:
        """To the caller's logger (an object or mapping with log, warn, error), else to ``logging``; never raises."""
        try:
            sink: Callable | None = None
            if self.logger is not None:
                sink = self.logger.get(level) if isinstance(self.logger, Mapping) else getattr(self.logger, level, None)
            if sink is not None:
                sink(message)
            elif self.logger is None:
                logging.getLogger("lakeloom").log({"error": 40, "warn": 30}.get(level, 20), message)
        except Exception:  # a logger must not break a load
            logging.getLogger("lakeloom").debug("logger failed", exc_info=True)
