"""Reproducible sharding by a Feistel permutation over global row numbers.

Rows are numbered 0..n-1 in a fixed order.  A keyed Feistel network permutes a
square of side ceil(sqrt(n)) that covers the numbers; a result outside 0..n-1 is
permuted again (cycle walking) until it is inside, so the numbers themselves are
permuted.  Position p goes to shard p mod S, slot p div S: counts differ by one
at most, slots have no gap, and place and number follow from each other without
a table (:func:`place_of`, :func:`number_at`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, materialize, number_rows, remove

ROUNDS = 6
SEED = 20_240_101
OVERHEAD_BYTES = 16  # what a row costs in a shard besides its text
WALK = 8  # steps of cycle walking in one pass


def _scramble(value: Column, seed: int, step: Column, side: int) -> Column:
    """Round function: 60 bits of MD5, which any other engine has too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", value, F.lit(seed), step)), 1, 15), 16, 10).cast("long") % F.lit(side).cast("long")


def permute(df: DataFrame, number: str, total: int, seed: int, out: str) -> DataFrame:
    """Add column ``out``, the place of row ``number`` in a permutation of 0..total-1.

    All but about 2 / sqrt(total) of the numbers are inside after one pass; the
    others are walked, a few steps a pass, until no row is outside.
    """
    if total <= 1:
        return df.withColumn(out, F.lit(0).cast("long"))
    side = math.isqrt(total - 1) + 1
    s = F.lit(side).cast("long")
    left, right = f"{out}_l", f"{out}_r"  # the halves as columns, so that each is computed once
    done = df.withColumns({left: F.expr(f"`{number}` div {side}L"), right: F.pmod(F.col(number).cast("long"), s)})
    for step in range(ROUNDS):
        done = done.withColumns({left: F.col(right), right: F.pmod(F.col(left) + _scramble(F.col(right), seed, F.lit(step), side), s)})
    done = done.withColumn(out, F.col(left) * s + F.col(right)).drop(left, right)
    done = materialize(done, "permuted")
    while not done.filter(F.col(out) >= total).isEmpty():
        walked = done.withColumn(out, F.when(F.col(out) < total, F.col(out)).otherwise(_walk(F.col(out), total, side, seed)))
        made = materialize(walked, "walked")
        remove(done)
        done = made
    return done


def _walk(x: Column, total: int, side: int, seed: int) -> Column:
    """Up to WALK steps of cycle walking, as a fold over a short array."""

    def half_steps(value: Column) -> Column:
        pair = F.struct(F.floor(value / F.lit(side)).cast("long").alias("l"), F.pmod(value, F.lit(side).cast("long")).alias("r"))
        rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
        swapped = F.aggregate(
            rounds,
            pair,
            lambda acc, step: F.struct(
                acc["r"].alias("l"),
                F.pmod(acc["l"] + _scramble(acc["r"], seed, step, side), F.lit(side).cast("long")).alias("r"),
            ),
            lambda acc: acc["l"] * F.lit(side).cast("long") + acc["r"],
        )
        return swapped

    return F.aggregate(F.array(*[F.lit(i) for i in range(WALK)]), x, lambda acc, _: F.when(acc < total, acc).otherwise(half_steps(acc)))


def place_of(position: int, shards: int) -> tuple[int, int]:
    """Shard and slot of a position."""
    return position % shards, position // shards


def number_at(shard: int, slot: int, shards: int) -> int:
    """Position at a shard's slot, the inverse of :func:`place_of`."""
    return slot * shards + shard


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = SEED) -> DataFrame:
    """Place every document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard, position.

    Law ``rows``: the row counts of any two shards differ by one at most, and
    slots are 0..count-1.  Row numbers follow (doc_id, crc32, size), nulls
    first, so the result does not depend on how the input is split; repeated
    rows get places of their own.  A null text has no bytes (size 16, crc32 0);
    a null doc_id is placed like any other.  Equal texts are not kept together:
    under this law a large group must spread.  Other columns are not read, and
    the text never moves: only three numbers a row are sorted and joined.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    small = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(OVERHEAD_BYTES)).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    numbered, total = number_rows(small, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "row_number")
    placed = permute(numbered, "row_number", total, seed, "position")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"position div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "position",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = SEED) -> DataFrame:
    """Write the documents in shard and slot order under ``path`` (one folder a shard); returns the placement.

    The rows themselves are numbered and permuted, in the order of
    :func:`shard_documents`, so rows that repeat get a place each without being
    matched.  The written columns ``shard`` and ``slot`` get another name where
    ``docs`` has them.
    """
    crc, size, number, position, shard, slot = fresh(docs, "_crc", "_size", "_number", "_position", "shard", "slot")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(crc, F.crc32(text)).withColumn(size, F.octet_length(text).cast("long") + OVERHEAD_BYTES)
    numbered, total = number_rows(keyed, [F.col("doc_id").cast("long"), F.col(crc), F.col(size)], number)
    placed = permute(numbered, number, total, seed, position)
    placed = placed.withColumn(shard, F.pmod(F.col(position), F.lit(shards)).cast("int")).withColumn(slot, F.expr(f"`{position}` div {shards}"))
    out = placed.select(*[col(c) for c in docs.columns], shard, slot)
    # A shard is cut in ranges of slots, so that no task writes a whole one.
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    made = placed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(size).alias("size"), F.col(crc).cast("long").alias("text_crc32"), F.col(shard).alias("shard"), F.col(slot).alias("slot"))
    made = materialize(made, "placement")
    remove(placed)
    return made
