"""Append-then-merge sessions.

Rows are staged as text; the session's end loads all of them as one batch, so
types are inferred from everything that was written and nothing is read back to
the driver.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoadError
from ..functions.values import as_text
from ..plans.profile import quoted
from ..sources.rows import as_frame

if TYPE_CHECKING:
    from ..engine import Engine, LoadResult

ABANDONED_SECONDS = 3600  # a staging folder without a heartbeat for so long belongs to no live session


def staging_name(prefix: str, table: str, run: str) -> str:
    return f"{prefix}{table}__{run}"


def is_staging_of(name: str, prefix: str, table: str) -> bool:
    return re.fullmatch(re.escape(prefix + table) + r"__[0-9a-f]{8}", name) is not None


class StreamSession:
    def __init__(self, engine: Engine, table: str, primary_key: Sequence[str], options: dict):
        self.engine, self.table, self.primary_key, self.options = engine, table, primary_key, options
        self.config = engine.config.with_(**options)
        self.files = engine.store.files
        self.run = uuid.uuid4().hex[:8]
        self.path = f"{engine.store.path}/{staging_name(self.config.staging_prefix, table, self.run)}"
        self.columns: list[str] | None = None
        self.closed = False
        if not self.config.keep_orphaned_staging:
            self._clean()
        self._beat()

    def _beat(self) -> None:
        self.files.replace(f"{self.path}/_heartbeat", str(time.time()))

    def _clean(self) -> None:
        """Delete staging of this table whose session is gone: no heartbeat for ABANDONED_SECONDS."""
        for name in self.files.names(self.engine.store.path):
            if is_staging_of(name, self.config.staging_prefix, self.table):
                beat = self.files.read(f"{self.engine.store.path}/{name}/_heartbeat")
                if beat is None or time.time() - float(beat) > ABANDONED_SECONDS:
                    self.files.delete(f"{self.engine.store.path}/{name}")

    def _open(self) -> None:
        if self.closed:
            raise LoadError("the session is closed")

    def write(self, chunk: DataFrame | list[Mapping]) -> None:
        """Stage a chunk.  The first fixes the columns; an empty one does nothing."""
        self._open()
        if not isinstance(chunk, DataFrame) and not chunk:
            return
        df = as_frame(self.engine.spark, chunk)
        if self.columns is None:
            self.columns = list(df.columns)
        if extra := [c for c in df.columns if c not in self.columns]:
            raise LoadError(f"columns that the first chunk did not have: {', '.join(extra)}")
        texts = [as_text(quoted(c), df.schema[c].dataType).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in self.columns]
        df.select(*texts).write.mode("append").parquet(f"{self.path}/rows")
        self._beat()

    def end(self) -> LoadResult:
        """Load everything staged.  The staging goes, whatever the result."""
        from ..engine import LoadResult

        self._open()
        self.closed = True
        try:
            if self.columns is None:
                return LoadResult(True, self.table)
            schema = T.StructType([T.StructField(c, T.StringType()) for c in self.columns])
            return self.engine.load(self.table, self.engine.spark.read.schema(schema).parquet(f"{self.path}/rows"), self.primary_key, **self.options)
        finally:
            self.files.delete(self.path)

    def abort(self) -> None:
        """Drop the staging without loading."""
        if not self.closed:
            self.closed = True
            self.files.delete(self.path)
