"""Set-based load operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.profile import quoted
from ..sources.scratch import number_rows


def last_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the last in ``order``.

    An aggregation (max_by) and not a window, so that the rows of a hot key are
    reduced before they are shuffled.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = F.max_by(F.struct(*[quoted(c) for c in rest]), rank).alias("_best")
    found = df.groupBy(*[quoted(k) for k in keys]).agg(best)
    return found.select(*[quoted(k) if c in keys else F.col("_best")[c].alias(c) for c in df.columns for k in [c]])


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def _on(a: str, b: str, keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys])


def upsert(target: DataFrame, staged: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), insert_only: bool = False) -> DataFrame:
    """Target after a merge: staged rows replace those of equal key, others are added.

    ``staged`` has one row a key.  Columns that it lacks, and those in ``keep``,
    stay as they are in rows that exist.  With ``insert_only`` existing rows stay
    as they are.  Without keys, rows are appended.  The target is shuffled once, by key.
    """
    columns = target.columns
    if not keys:
        return target.unionByName(staged, allowMissingColumns=True).select(*[quoted(c) for c in columns])
    if insert_only:
        fresh = staged.alias("s").join(target.select(*[quoted(k) for k in keys]).alias("t"), _on("s", "t", keys), "left_anti")
        return target.unionByName(fresh, allowMissingColumns=True).select(*[quoted(c) for c in columns])
    held = [c for c in columns if c not in keys and (c in keep or c not in staged.columns)]
    if not held:
        old = target.alias("t").join(staged.select(*[quoted(k) for k in keys]).alias("s"), _on("t", "s", keys), "left_anti")
        return old.unionByName(staged.select(*[quoted(c) for c in columns]))
    marked = staged.withColumn("_staged", F.lit(True)).alias("s")
    both = target.withColumn("_held", F.lit(True)).alias("t").join(marked, _on("t", "s", keys), "full")
    out = []
    for c in columns:
        new = F.col(f"s.`{c}`") if c in staged.columns else F.lit(None)
        was = F.col(f"t.`{c}`")
        if c in held:
            value = F.when(F.col("_held"), was).otherwise(new)
        else:
            value = F.when(F.col("_staged"), new).otherwise(was)
        out.append(value.cast(target.schema[c].dataType).alias(c))
    return both.select(*out)


def before_image(target: DataFrame, staged: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Rows of the target that a merge will change: equal key, and a compared column that differs (null-safe)."""
    compare = [c for c in compare if c not in keys and c in staged.columns]
    if not compare or not keys:
        return target.limit(0)
    differs = reduce(or_, [~F.col(f"t.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in compare])
    return target.alias("t").join(staged.alias("s"), _on("t", "s", keys)).filter(differs).select("t.*")


def unique_conflicts(target: DataFrame, staged: DataFrame, keys: Sequence[str], unique: Sequence[Sequence[str]]) -> DataFrame:
    """For each unique index: how many pairs of a target and a staged row have different keys and equal values.

    No pair is made: rows are counted by value on both sides, the products are
    summed, and those of equal key, counted by value and key, are taken off.
    Null values conflict with nothing.
    """

    def pairs(columns: Sequence[str], nullable: Sequence[str]) -> DataFrame:
        counted = [df.groupBy(*[quoted(c) for c in (*columns, *nullable)]).agg(F.count(F.lit(1)).alias("_n")).alias(a) for df, a in ((target, "t"), (staged, "s"))]
        same = [F.col(f"t.`{c}`") == F.col(f"s.`{c}`") for c in columns]
        joined = counted[0].join(counted[1], reduce(and_, same + ([_on("t", "s", nullable)] if nullable else [])))
        return joined.agg(F.coalesce(F.sum(F.col("t._n") * F.col("s._n")), F.lit(0)).alias("pairs"))

    parts = []
    for columns in unique:
        index = F.lit(",".join(columns)).alias("unique_index")
        parts.append(pairs(columns, []).select(index, "pairs"))
        if keys:
            parts.append(pairs(columns, [k for k in keys if k not in columns]).select(index, (-F.col("pairs")).alias("pairs")))
    return reduce(DataFrame.unionAll, parts).groupBy("unique_index").agg(F.sum("pairs").cast("long").alias("conflicts"))


def matched(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> tuple[int, set[str]]:
    """Staged rows whose key the target has, and the names of the target's Parquet files that hold one; reads the target's keys only.

    The range of the staged keys goes to the target's scan, so that files and row
    groups outside it are not read.
    """
    first = keys[0]
    low, high = staged.agg(F.min(quoted(first)), F.max(quoted(first))).first()
    there = target.select(*[quoted(k) for k in keys], F.col("_metadata.file_name").alias("_file"))
    if low is not None and staged.filter(quoted(first).isNull()).isEmpty():
        there = there.filter(quoted(first).between(F.lit(low), F.lit(high)))
    row = there.alias("t").join(staged.select(*[quoted(k) for k in keys]).alias("s"), _on("t", "s", keys)).agg(F.count(F.lit(1)), F.collect_set("_file")).first()
    return row[0], set(row[1])


def conflicting_rows(target: DataFrame, staged: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Staged rows that a unique index of the target refuses: the value is there under another key.

    Of each value the target sends at most the two keys that come first and
    last: if both are the staged row's own, there is no other.
    """
    key = F.struct(*[quoted(k) for k in keys])
    ends = target.groupBy(*[quoted(c) for c in columns]).agg(F.min(key).alias("_least"), F.max(key).alias("_most")).alias("t")
    same = reduce(and_, [F.col(f"t.`{c}`") == F.col(f"s.`{c}`") for c in columns])
    own = F.struct(*[F.col(f"s.`{k}`") for k in keys])
    return staged.alias("s").join(ends, same & ~(own.eqNullSafe(F.col("t._least")) & own.eqNullSafe(F.col("t._most"))), "left_semi")


def number_new_rows(df: DataFrame, name: str, start: int, order: Sequence[Column] = ()) -> DataFrame:
    """Surrogate numbers for staged rows: from ``start`` up, unique, without a sort of the whole in one task.

    With ``order`` numbers follow it without gaps; without, they have gaps between partitions.
    """
    if not order:
        return df.withColumn(name, F.monotonically_increasing_id() + F.lit(start))
    numbered, _ = number_rows(df, list(order), name)
    return numbered.withColumn(name, quoted(name) + F.lit(start))
