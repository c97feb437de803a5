"""Intermediate results in the folder that driver and executors share, and row numbers built on them."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scopes = threading.local()  # paths written within each settle() under way
_settings: dict[str, list] = {}  # blocks under way for each setting, and its value before the first
_settings_lock = threading.Lock()
COMPILED_BYTES = 8000  # fixed by HotSpot (HugeMethodLimit)
ROW_IN_PARTITION_BITS = 33  # fixed by Spark's monotonically_increasing_id()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor share, from ``spark.checkpoint.dir``.

    Only where the session does not name one and all runs on this machine is a
    temporary folder made and set; on a cluster no such folder is shared, so a
    session without the setting is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lakeloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Written files survive a lost executor, and everything below is computed once.
    The write's own shuffle files go as soon as it is done.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    if scopes := getattr(_scopes, "open", None):
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Materialize what ``make`` returns, then delete the intermediate results written on the way there."""
    scopes = _scopes.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        out = materialize(make(), name)
    except BaseException:
        scopes.pop()
        raise
    *inner, kept = scopes.pop()
    for path in inner:
        _delete(spark, path)
    if scopes:
        scopes[-1].append(kept)
    return out


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs that run within the block; of blocks of several threads that overlap, the last to end restores it."""
    with _settings_lock:
        held = _settings.setdefault(key, [0, spark.conf.get(key, None)])
        held[0] += 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _settings_lock:
            held[0] -= 1
            if not held[0]:
                before = _settings.pop(key)[1]
                if before is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, before)


def small_methods(spark: SparkSession):
    """Plans of long expressions without one method for a whole stage.

    The JVM interprets methods beyond 8,000 bytes for good; Spark writes such
    ones for a stage, but splits an operator's own expressions into short ones.
    """
    return setting(spark, "spark.sql.codegen.hugeMethodLimit", str(COMPILED_BYTES))


def remove(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SPREAD_BYTES = 32 << 20  # bytes a core up to which a frame is dealt over all cores


def spread(df: DataFrame) -> DataFrame:
    """A frame of few bytes in as many partitions as there are cores; a larger one has enough of its own.

    Small files are one partition each, however much work their values take.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES * cores else df


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> tuple[DataFrame, int]:
    """Number the rows 0..n-1 in the total order ``order``; also return n.

    A range-partitioned sort is written once with each row's partition and
    position; only one count per partition reaches the driver.  No window over
    the whole table and no single task sees all rows.  Rows that tie in
    ``order`` get neighbouring numbers, so ``order`` should cover all columns
    that matter.
    """
    made = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()),
        "rows",
    )
    part = F.shiftright(col(name), ROW_IN_PARTITION_BITS)
    counts = sorted(tuple(r) for r in made.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    start, total = {}, 0
    for p, n in counts:
        start[p] = total
        total += n
    if not counts:
        return made, 0
    starts = F.array(*[F.lit(start.get(p, 0)).cast("long") for p in range(counts[-1][0] + 1)])
    row = col(name).bitwiseAND(F.lit((1 << ROW_IN_PARTITION_BITS) - 1))
    return made.withColumn(name, F.element_at(starts, part.cast("int") + F.lit(1)) + row), total
