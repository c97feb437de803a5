"""Row sources: Python rows, JSON lines, files and JDBC."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.ddl import single_statement


def is_rows(data: object) -> bool:
    """Whether data is a non-empty list whose first element is a mapping."""
    return isinstance(data, (list, tuple)) and bool(data) and isinstance(data[0], Mapping)


def column_union(rows: Iterable[Mapping]) -> list[str]:
    """All keys of ragged rows, in order of first sight."""
    return list(dict.fromkeys(k for r in rows for k in r))


def from_rows(spark: SparkSession, rows: list[Mapping]) -> DataFrame:
    """Frame of ragged Python rows; a row without a key has null there.

    A column of one kind of scalar keeps it; nested values and columns of mixed
    kinds become text (JSON for nested values), so that typing decides.
    """
    if not is_rows(rows):
        raise ValueError("rows must be a non-empty list of mappings")
    names = column_union(rows)
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    fields, plain = [], {}
    for n in names:
        seen = {type(r[n]) for r in rows if r.get(n) is not None}
        one = next(iter(seen)) if len(seen) == 1 else None
        fits = one in kinds and (one is not int or all(-(2**63) <= r[n] < 2**63 for r in rows if r.get(n) is not None))
        if seen == {int, float}:
            one, fits = float, True
        plain[n] = one if fits else None
        fields.append(T.StructField(n, kinds[one] if fits else T.StringType()))

    def cell(value: object, one: type | None) -> object:
        if value is None:
            return None
        if one is not None:
            return one(value)
        if isinstance(value, (dict, list, tuple)):
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        return str(value).lower() if isinstance(value, bool) else str(value)

    return spark.createDataFrame([tuple(cell(r.get(n), plain[n]) for n in names) for r in rows], T.StructType(fields))


def as_frame(spark: SparkSession, data: DataFrame | list[Mapping]) -> DataFrame:
    return data if isinstance(data, DataFrame) else from_rows(spark, list(data))


def frames(spark: SparkSession, chunks: Iterable[DataFrame | list[Mapping]]) -> Iterator[DataFrame]:
    """Frames of a chunked source; empty chunks are skipped, and the source is closed even if the reader stops early."""
    try:
        for chunk in chunks:
            if isinstance(chunk, DataFrame):
                if not chunk.isEmpty():
                    yield chunk
            elif chunk:
                yield from_rows(spark, list(chunk))
    finally:
        close = getattr(chunks, "close", None)
        if close is not None:
            close()


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ragged keys; scalars stay text, so that typing decides."""
    return spark.read.option("primitivesAsString", "true").json(path)


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.read.options(header="true", inferSchema="false", multiLine="true", escape='"', **options).csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table or single statement of a database; ``partition`` is (column, lower, upper, parts).  Needs the driver's jar."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition:
        names = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
        reader = reader.option("dbtable", query).options(**{k: str(v) for k, v in zip(names, partition, strict=True)})
        return reader.load()
    if not single_statement(query):
        raise ValueError("not a single statement")
    return reader.option("query", query).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode(mode).save()
