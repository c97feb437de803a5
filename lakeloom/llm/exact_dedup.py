"""Exact deduplication with a log-structured merge index of text digests.

The index takes ``(digest, identifier)`` entries batch by batch.  A batch's
memtable, the partial aggregation of its tasks, keeps the smallest identifier and
the number of entries of each digest; it is flushed as a run, Parquet files in
digest order beside a filter of the run's digests.  The digests of a batch are
looked up in every older run: most that are not there are told by the filter, so
that only hits and few others meet the run itself.  Once a level has FANOUT runs
they are compacted to one run of the next level, which keeps the smallest
identifiers; so each entry is rewritten a logarithmic number of times.

A digest hit is only a candidate: the normalised texts are compared byte for
byte before a row is called a copy.  Everything is DataFrame operators.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files
from .common import BLOCK_BITS, bit_is_set, materialize, new_path, sift

WHITE = r"[\x20\x09-\x0D]+"  # runs that count as one space
FANOUT = 4  # runs of a level that are compacted together
MEMTABLE_ROWS = 1 << 15  # entries of a batch for each core of the cluster
BATCHES_MOST = 32  # a larger input has larger batches
FILTER_BITS, FILTER_PROBES = 16, 4  # of a run's filter, for each digest: about 0.2 % of other digests pass
REPEATS = 1 << 16  # rows made from one counted row at a time


def normalized(text: Column) -> Column:
    """Text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class Run:
    """A sorted run: digest, keep_id, entries; and its filter: block, bits, of ``blocks`` blocks."""

    level: int
    number: int
    rows: DataFrame
    filter: DataFrame
    blocks: int


class DigestIndex:
    """A log-structured index ``digest -> smallest identifier, entries`` in a shared folder; a path that has one goes on with it."""

    ROWS = "digest binary, keep_id long, entries long"
    FILTER = "block long, bits binary"

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.path = path or new_path(spark, "lsm")
        self.files = Files(spark)
        names = [re.fullmatch(r"run-([0-9]+)-([0-9]+)-([0-9]+)", n) for n in self.files.names(self.path)]
        self.runs = sorted((self._opened(*map(int, m.groups())) for m in names if m and self.files.exists(f"{self.path}/{m[0]}/rows/_SUCCESS")), key=lambda r: r.number)

    def _opened(self, level: int, number: int, blocks: int) -> Run:
        folder = f"{self.path}/run-{level}-{number}-{blocks}"
        read = lambda schema, part: self.spark.read.schema(schema).parquet(f"{folder}/{part}")
        return Run(level, number, read(self.ROWS, "rows"), read(self.FILTER, "filter"), blocks)

    def _places(self, digests: DataFrame, blocks: int) -> tuple[Column, list[Column]]:
        """Block of a digest and its bits there."""
        mixed = F.xxhash64(F.lit(1), F.col("digest"))
        return F.pmod(F.xxhash64("digest"), F.lit(blocks)), [F.pmod(F.shiftright(mixed, 15 * i), F.lit(BLOCK_BITS)) for i in range(FILTER_PROBES)]

    def _write(self, level: int, rows: DataFrame) -> Run:
        """Write a run: its filter first, so that a run with rows is whole."""
        number = max((r.number for r in self.runs), default=-1) + 1
        draft = f"{self.path}/draft-{number}"
        rows.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(draft)
        made = self.spark.read.schema(self.ROWS).parquet(draft)
        blocks = max(1, -(-made.count() * FILTER_BITS // BLOCK_BITS))
        block, bits = self._places(made, blocks)
        folder = f"{self.path}/run-{level}-{number}-{blocks}"
        spread = made.select(block.alias("block"), F.explode(F.array(*bits)).alias("at"))
        spread.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).write.parquet(f"{folder}/filter")
        self.files.move(draft, f"{folder}/rows")
        return self._opened(level, number, blocks)

    def flush(self, batch: DataFrame) -> DataFrame:
        """Add ``digest, keep_id`` entries as a run; returns the digests that are in the index more than once by them."""
        older = list(self.runs)
        run = self._write(0, batch.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("entries")))
        twice = run.rows.filter("entries > 1").select("digest")
        hits = [twice, *(self._found(run.rows.select("digest"), r).select("digest") for r in older)]
        hits = materialize(reduce(DataFrame.unionByName, hits).distinct(), "hits")
        self.runs.append(run)
        self._compact()
        return hits

    def _found(self, digests: DataFrame, run: Run) -> DataFrame:
        """Entries of a run whose digest is asked for, through its filter."""
        block, bits = self._places(digests, run.blocks)
        asked = digests.withColumn("own", block).join(run.filter, F.col("own") == F.col("block"))
        passed = asked.filter(reduce(Column.__and__, [bit_is_set(F.col("bits"), b) for b in bits])).select("digest")
        return run.rows.join(passed, "digest")

    def lookup(self, digests: DataFrame) -> DataFrame:
        """Smallest identifier (nulls last) and number of entries of each of the distinct ``digests`` that the index has."""
        found = [self._found(digests, r) for r in self.runs]
        if not found:
            return self.spark.createDataFrame([], self.ROWS)
        if len(found) == 1:
            return found[0]
        return reduce(DataFrame.unionByName, found).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("entries").alias("entries"))

    def _compact(self) -> None:
        """Merge the runs of every full level to one of the next, lowest level first."""
        level = 0
        while any(r.level >= level for r in self.runs):
            full = [r for r in self.runs if r.level == level]
            if len(full) >= self.fanout:
                merged = reduce(DataFrame.unionByName, [r.rows for r in full]).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("entries").alias("entries"))
                run = self._write(level + 1, merged)
                self.runs = [r for r in self.runs if r.level != level] + [run]
                for r in full:
                    self.files.delete(f"{self.path}/run-{r.level}-{r.number}-{r.blocks}")
            level += 1


def exact_dedup(docs: DataFrame, memtable_rows: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of the rows whose normalised texts are equal, that with the smallest doc_id
    stays.  Null text is empty text, and all empty texts are one group.  A null
    doc_id never is the smallest unless a group has no other; rows that repeat
    the kept doc_id with the same text all count in ``group_size``, one of them
    is kept.  Other columns are not read.  ``memtable_rows`` is the size of a
    batch of the index.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("norm"))
    entries = materialize(rows.select("doc_id", digest(F.col("norm")).alias("digest")), "digests")
    least = memtable_rows or MEMTABLE_ROWS * spark.sparkContext.defaultParallelism
    batches = max(1, min(BATCHES_MOST, -(-entries.count() // least)))
    index = DigestIndex(spark)
    hits = []
    for i in range(batches):
        batch = entries.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i)
        hits.append(index.flush(batch.select("digest", F.col("doc_id").alias("keep_id"))))
    groups = materialize(index.lookup(reduce(DataFrame.unionByName, hits).distinct()), "groups")

    # Byte check of the hits: equal texts have one least and one greatest text.  Each task sends these two of a digest at most,
    # so that a large group is not in one task; single texts are sifted out before they are sent.
    texts = sift(rows.withColumn("digest", digest(F.col("norm"))), F.xxhash64("digest"), groups, F.xxhash64("digest"))
    ends = texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    unequal = materialize(ends.filter("least <> most").select("digest"), "unequal")
    level = groups.withColumnsRenamed({"keep_id": "group_id", "entries": "group_size"})
    seen = entries.join(level, "digest", "left")
    seen = seen.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("group_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    seen = seen.select("doc_id", "digest", "keep_id", "group_size")
    if not unequal.isEmpty():  # different texts of one digest: they are grouped by the text itself
        apart = rows.withColumn("digest", digest(F.col("norm"))).join(unequal, "digest")
        sizes = apart.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = apart.join(sizes, ["digest", "norm"]).select("doc_id", "digest", "keep_id", "group_size")
        seen = seen.join(unequal, "digest", "left_anti").unionByName(apart)
        repeated = seen.filter("doc_id <=> keep_id and group_size > 1").groupBy("digest", "keep_id").agg(F.count(F.lit(1)).alias("same")).filter("same > 1")
    else:  # by digest and identifier, so that the rows of a large group are in many tasks
        twice = entries.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("same")).filter("same > 1")
        repeated = twice.join(groups, "digest").filter("doc_id <=> keep_id").select("digest", "keep_id", "same")
    return _kept(seen, materialize(repeated, "repeated"))


def _kept(seen: DataFrame, repeated: DataFrame) -> DataFrame:
    """Mark the row that stays; where the kept identifier itself repeats, one of its rows does."""
    out = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    seen = seen.withColumn("kept", F.expr("doc_id <=> keep_id")).withColumn("text_sha256", F.lower(F.hex("digest")))
    if repeated.isEmpty():
        return seen.select(*out)
    again = repeated.select(F.col("digest").alias("_d"), F.col("keep_id").alias("_k"))
    same = F.expr("kept and digest = _d and keep_id <=> _k")
    rest = seen.join(again, same, "left_anti")
    # Repeated rows are all alike: they are counted, and made again from the count in parts of bounded size.
    many = seen.filter("kept").join(again, same, "left_semi").groupBy("doc_id", "keep_id", "group_size", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    many = many.withColumn("part", F.explode(F.expr(f"sequence(0, (n - 1) div {REPEATS})"))).repartition("text_sha256", "keep_id", "part")
    many = many.withColumn("i", F.explode(F.expr(f"sequence(part * {REPEATS}, least(n, (part + 1) * {REPEATS}) - 1)"))).withColumn("kept", F.expr("i = 0"))
    return rest.select(*out).unionByName(many.select(*out))
