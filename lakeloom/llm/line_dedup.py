"""Removal of boilerplate lines by their spread over distinct sites.

A line that many sites carry is boilerplate.  Per line hash, HyperLogLog
sketches of the sites are built and merge by aggregation, so that a line of any
frequency costs one small sketch a task.  A sketch decides what is far from the
threshold; lines near it get exact distinct counts.  A boilerplate line stays in
the document with the smallest doc_id that has it and goes from all others, so
no line is lost altogether, even where whole documents were copied.
Everything is DataFrame operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, materialize

MIN_SITES = 5  # distinct sites from which a line is boilerplate
SKETCH_BITS = 12  # relative standard error about 1.04 / sqrt(2 ** 12) = 1.6 %
MARGIN = 0.1  # estimates within this share of the threshold (1 site at least) are counted exactly: over six standard errors


def line_key(line: Column) -> Column:
    """128-bit hash of a line without the white space at its ends; null for a blank line."""
    bare = F.regexp_replace(line, r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(bare != "", F.unhex(F.md5(bare)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def hashed_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """doc_id, text_hash, site and the hash of each distinct line: texts are split and hashed this once."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    lines = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), col(site).cast("string").alias("site"), F.explode(keys).alias("line"))
    return materialize(lines.filter("line is not null"), "lines")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Of :func:`hashed_lines`, those on ``min_sites`` sites or more: line (hash), first_doc (smallest doc_id with it).  A null site is no site."""
    sketched = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("estimate"), F.min("doc_id").alias("first_doc")
    )
    margin = max(1.0, MARGIN * min_sites)
    wide = materialize(sketched.filter(F.col("estimate") >= min_sites - margin), "wide")
    near = wide.filter(F.col("estimate") <= min_sites + margin).select("line")
    # Pre-aggregation to one row for each line and site in each task, then for each line.
    exact = lines.join(near, "line", "left_semi").filter("site is not null").select("line", "site").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    exact = exact.filter(F.col("sites") >= min_sites).select("line")
    sure = wide.filter(F.col("estimate") > min_sites + margin).select("line", "first_doc")
    return sure.unionByName(wide.join(exact, "line", "left_semi").select("line", "first_doc"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """All columns of ``docs`` with boilerplate lines taken out of ``text``.

    Every row stays, an emptied one with an empty text.  With ``drop_emptied``,
    rows go whose text had other than white space and has none left: each of
    their lines stands in a document with a smaller doc_id.  ``n_chars``, where
    there is such a column, follows a changed text.  With ``counts``, the columns
    ``n_lines`` and ``n_removed`` are added.  Null text stays null and has no
    lines; blank lines are never boilerplate; null sites don't count; a null
    doc_id is first only where no row with a doc_id has the line.  Rows that
    repeat a doc_id keep or lose a line together.
    """
    made = hashed_lines(docs, site)
    bad = boilerplate(made, min_sites).withColumnsRenamed({"line": "_bad_line", "first_doc": "_first"})
    held, hashed, gone, lines = fresh(docs, "_held_by", "_hashed", "_gone", "_lines")
    hits = made.join(bad, F.col("line") == F.col("_bad_line")).filter(~F.col("doc_id").eqNullSafe(F.col("_first")))
    # By row and not by doc_id alone, which may be null in any number of rows: no more than a text has lines.
    hits = hits.groupBy(F.col("doc_id").alias(held), F.col("text_hash").alias(hashed)).agg(F.collect_set("line").alias(gone))
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits[held]) & (F.xxhash64(docs["text"]) == hits[hashed]), "left")
    kept = F.filter(lines_of(F.col("text")), lambda x: ~F.coalesce(F.array_contains(F.col(gone), line_key(x)), F.lit(False)))
    joined = joined.withColumn(lines, F.when(F.col(gone).isNotNull(), kept))
    if drop_emptied:  # only rows that lost a line: a text that was blank before stays
        left = F.exists(F.col(lines), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        joined = joined.filter(F.col(gone).isNull() | left)
    changed = {"text": F.when(F.col(gone).isNotNull() & F.col("text").isNotNull(), F.array_join(F.col(lines), "\n")).otherwise(F.col("text"))}
    out = [changed.get(c, col(c)).alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out[docs.columns.index("n_chars")] = F.when(F.col(gone).isNotNull(), F.length(changed["text"]).cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    if counts:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_of(F.col("text"))))
        left = F.when(F.col(gone).isNotNull(), F.size(F.col(lines))).otherwise(n)
        out += [n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_removed")]
    return joined.select(*out)
