"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import col, materialize, new_path, number_rows, remove, setting, settle, shared_dir

__all__ = ["bit_is_set", "col", "fresh", "materialize", "new_path", "number_rows", "remove", "repeat_rows", "setting", "settle", "shared_dir", "sift"]

FILTER_LEAST, FILTER_MOST = 1 << 16, 1 << 26  # bits of a filter that is sent to all tasks
BLOCK_BITS = 32768  # bits of one bitmap, as bitmap_construct_agg makes them


def bit_is_set(bits: Column, at: Column) -> Column:
    """Whether a bitmap of bitmap_construct_agg has bit ``at`` (from 0)."""
    byte = F.conv(F.hex(F.substring(bits, F.expr("1") + F.floor(at / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))).cast("int"), F.lit(2)) == 1


def sift(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The ``rows`` whose hash ``key`` is among those of ``wanted``, and some others.

    A filter of at most FILTER_MOST bits is sent to all tasks, so that most other
    rows are spared what follows; with more wanted rows than it can tell apart it
    lets all through, and nothing depends on it.
    """
    slots = min(FILTER_MOST, max(FILTER_LEAST, 1 << (16 * wanted.count()).bit_length()))
    place = F.pmod(wanted_key, F.lit(slots))
    block, at, bits, own = fresh(rows, "_block", "_at", "_bits", "_own")
    words = wanted.select(F.floor(place / BLOCK_BITS).alias(block), F.pmod(place, F.lit(BLOCK_BITS)).alias(at)).groupBy(block).agg(F.bitmap_construct_agg(at).alias(bits))
    place = F.pmod(key, F.lit(slots))
    marked = rows.withColumns({own: F.floor(place / BLOCK_BITS), at: F.pmod(place, F.lit(BLOCK_BITS))})
    marked = marked.join(F.broadcast(words), F.col(own) == F.col(block))
    return marked.filter(bit_is_set(F.col(bits), F.col(at))).select(*[col(c) for c in rows.columns])


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says, without an array as long as that."""
    part, i = fresh(df, "_part", "_i")
    parts = df.withColumn(part, F.explode(F.expr(f"sequence(0L, (`{times}` - 1) div 65536)")))
    return parts.withColumn(i, F.explode(F.expr(f"sequence(`{part}` * 65536, least(`{times}`, (`{part}` + 1) * 65536) - 1)"))).drop(part, i)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that ``df`` does not have (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
