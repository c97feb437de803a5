"""Connected components of a large graph by alternating star contraction.

Each round first points every neighbour above a node, then every neighbour below
it, to the least node around (the large-star and small-star operations of the
published algorithm); O(log n) rounds turn each component into a star around its
least node.  A round is aggregations with partial sums and equi-joins that can be
split when a node has very many edges; neighbours are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Edges (u < v): every neighbour above a node moves to the least node around it."""
    around = _both(edges)
    moved = around.join(_least(around), "u").filter("v > u").select(F.col("m").alias("u"), "v")
    return moved.filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges (u < v): a node and its neighbours below it move to the least of them."""
    down = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v")
    return moved.unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``, root the least node of its component.

    Self-loops and repeated edges are allowed; nodes without a proper edge are
    not returned.  An empty graph gives no rows.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = materialize(edges.select(low.alias("u"), high.alias("v")).filter("u < v").distinct(), "edges")
    mark = None
    while True:
        made = materialize(_small(_large(now)), "stars")
        remove(now)
        now = made
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)
