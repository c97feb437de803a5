"""Errors that callers may want to tell apart."""


class LoadError(Exception):
    code = "load_error"


class SchemaLockTimeoutError(LoadError):
    code = "schema_lock_timeout"


class SchemaDriftError(LoadError):
    code = "schema_drift"


class ConcurrentLoadError(LoadError):
    """Another load has published the table since this one was planned."""

    code = "concurrent_load"


class DuplicateKeyError(LoadError):
    code = "duplicate_key"


class UniqueConflictError(LoadError):
    code = "unique_conflict"


class RejectedRowsError(LoadError):
    code = "rejected_rows"
