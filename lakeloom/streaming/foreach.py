"""Structured Streaming input: every micro-batch is one load, recorded with its commit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..errors import LoadError

if TYPE_CHECKING:
    from ..engine import Engine


def batch_loader(engine: Engine, stream: str, table: str, primary_key: Sequence[str] = (), **options: object) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``.

    A batch's number is committed together with its rows, so a batch that is
    replayed after a failure is skipped and each row is loaded once.
    """

    def load(df: DataFrame, batch: int) -> None:
        if batch <= engine.store.done(stream) or df.isEmpty():
            return
        result = engine.load(table, df, primary_key, mark=(stream, batch), freeze_keys=engine.store.exists(table), **options)
        if not result.success:
            raise LoadError(result.error)

    return load


def load_stream(engine: Engine, source: DataFrame, stream: str, table: str, checkpoint: str, primary_key: Sequence[str] = (), **options: object) -> DataStreamWriter:
    """Writer that loads ``source`` into a table; start it with the trigger of your choice."""
    return source.writeStream.foreachBatch(batch_loader(engine, stream, table, primary_key, **options)).option("checkpointLocation", checkpoint)
