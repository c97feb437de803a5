"""Schema history, drift detection and run audit as small append-only logs.

An event is a file that is created exclusively, so two writers cannot take one
version.  A log has one event a migration or load; its readers are driver code,
and frames of it are made for queries.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from ..config import LoadConfig
from ..errors import SchemaDriftError
from ..header import Header
from .store import Store

STALE_SECONDS = 3600
ATTEMPTS = 5
HISTORY_SCHEMA = "table_name string, version long, status string, applied_at timestamp, applied_by string, previous_schema string, new_schema string, changes string, checksum string"
RUN_SCHEMA = (
    "run_id string, table_name string, started_at timestamp, finished_at timestamp, duration_ms long, mode string, success boolean, rows long, inserted long, "
    "updated long, rejected long, rows_per_second double, schema_changed boolean, error_code string, error_message string"
)


def applied_by() -> str:
    return f"{socket.gethostname()}:{os.getpid()}"


class Catalog:
    def __init__(self, store: Store, config: LoadConfig):
        self.store, self.config, self.files = store, config, store.files
        self.folder = f"{store.path}/_schema_history"

    def events(self, table: str) -> list[dict]:
        """Latest state of each version of a table, in order."""
        folder = f"{self.folder}/{table}"
        found: dict[int, dict] = {}
        for name in self.files.names(folder):  # NNNNNN.start.json sorts before NNNNNN.state.json
            version, kind, _ = name.split(".", 2)
            data = json.loads(self.files.read(f"{folder}/{name}"))
            found[int(version)] = found.get(int(version), {}) | data
        return [found[v] for v in sorted(found)]

    def start(self, table: str, previous: Header | None, changes: dict) -> int | None:
        """Record a pending migration; its version, or None if that failed (the load goes on)."""
        try:
            for e in self.events(table):
                if e["status"] == "pending" and time.time() - e["time"] > STALE_SECONDS:
                    self._state(table, e["version"], "failed")
            for _ in range(ATTEMPTS):
                version = max((e["version"] for e in self.events(table)), default=0) + 1
                event = {
                    "table_name": table, "version": version, "status": "pending", "time": time.time(), "applied_by": applied_by(),
                    "previous_schema": previous.as_json() if previous else None, "changes": changes, "new_schema": None, "checksum": None,
                }
                if self.files.create(f"{self.folder}/{table}/{version:06d}.start.json", json.dumps(event, default=str)):
                    return version
        except Exception as e:
            self.config.log("warn", f"schema history of {table} not started: {e}")
        return None

    def _state(self, table: str, version: int, status: str, **more: object) -> None:
        data = {"status": status, "time": time.time(), **more}
        self.files.replace(f"{self.folder}/{table}/{version:06d}.state.json", json.dumps(data, default=str))

    def finish(self, table: str, version: int | None, status: str, header: Header | None = None) -> None:
        """Close a migration as applied, failed or rolled_back."""
        if version is None:
            return
        try:
            more = {"new_schema": header.as_json(), "checksum": header.checksum()} if header else {}
            self._state(table, version, status, **more)
        except Exception as e:
            self.config.log("warn", f"schema history of {table} not closed: {e}")

    def latest(self, table: str) -> dict | None:
        return next((e for e in reversed(self.events(table)) if e["status"] == "applied"), None)

    def check_drift(self, table: str, actual: Header | None) -> bool:
        """Whether a table's header is another than the last applied one; strict mode raises."""
        try:
            last = self.latest(table)
        except Exception as e:
            self.config.log("warn", f"schema history of {table} is unreadable: {e}")
            return False
        if last is None or actual is None or not last.get("checksum") or last["checksum"] == actual.checksum():
            return False
        message = f"the schema of {table} has changed outside of the recorded migrations"
        if self.config.strict_drift_detection:
            raise SchemaDriftError(message)
        self.config.log("warn", message)
        return True

    def schema_at(self, table: str, at: float) -> Header | None:
        """Header in force at a time (seconds since 1970)."""
        past = [e for e in self.events(table) if e["status"] == "applied" and e["time"] <= at]
        return Header.from_json(max(past, key=lambda e: (e["time"], e["version"]))["new_schema"]) if past else None

    def history_frame(self, table: str) -> DataFrame:
        rows = [
            (
                e["table_name"], e["version"], e["status"], datetime.fromtimestamp(e["time"], UTC), e["applied_by"],
                *[json.dumps(e[k]) if e.get(k) is not None else None for k in ("previous_schema", "new_schema", "changes")], e.get("checksum"),
            )
            for e in self.events(table)
        ]
        return self.store.spark.createDataFrame(rows, HISTORY_SCHEMA)

    def audit(self, run: dict) -> None:
        """Append one load's figures; never raises."""
        if not self.config.run_audit:
            return
        try:
            self.files.create(f"{self.store.path}/_runs/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json", json.dumps(run, default=str))
        except Exception as e:
            self.config.log("warn", f"run audit not written: {e}")

    def runs_frame(self) -> DataFrame:
        path = f"{self.store.path}/_runs"
        if not self.files.names(path):
            return self.store.spark.createDataFrame([], RUN_SCHEMA)
        return self.store.spark.read.schema(RUN_SCHEMA).json(path)
