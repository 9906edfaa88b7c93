"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spread import with_totals
from ._store import drop, kept


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every node's larger neighbours (large) or itself and its smaller ones (small) to the least of them.

    edges are distinct, so in a small star the least neighbour stands in one row, which links the node itself.
    """
    both = _symmetric(edges)
    if large:
        found = with_totals(both, "a", "b", F.least(F.min("b"), F.col("a")).alias("least")).where(F.col("b") > F.col("a"))
        node = F.col("b")
    else:
        found = with_totals(both.where(F.col("b") < F.col("a")), "a", "b", F.min("b").alias("least"))
        node = F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b"))
    return found.select(node.alias("a"), F.col("least").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _print(edges: DataFrame) -> tuple[int, int]:
    """Enough of a table of links to see whether it has changed."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("x")).first()
    return r.n, r.x or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b); a component is named by its least node.

    Needs about the logarithm of the longest chain in rounds. Each round joins the links with one least
    neighbour per node, by node and place, so that the links of a node with very many of them are dealt over
    tasks, and is written to the shared folder.
    """
    spark = edges.sparkSession
    now = kept(edges.where(F.col("a") != F.col("b")).distinct(), "links")
    seen = _print(now)
    while True:
        new = kept(_star(_star(now, large=True), large=False), "links")
        found = _print(new)
        drop(now)
        now = new
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
