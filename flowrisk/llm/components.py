"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is a grouped minimum and an equi-join on the links, both spread over their keys
(a hot node's links are pre-aggregated in the minimum, and its partition is split in the
join).  Each round is written to the shared folder, so that the lineage stays short and a
lost executor costs one round.  Rounds go on until the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.session import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round: every node's neighbours go to the least of its neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.where("b < a")
    least = side.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    if large:
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = side.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)`` (longs, any direction).

    The component is the least node that can be reached.  Links of a node with itself and
    repeated links change nothing; no links give no rows.
    """
    links = stage(links.select("a", "b").where("a <> b").distinct(), "links")
    mark = _mark(links)
    while True:
        links = stage(_star(_star(links, True), False), "links")
        last, mark = mark, _mark(links)
        if mark == last:
            break
    # all links lead straight to the least node now
    leaf = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return leaf.union(leaf.select(F.col("component").alias("node"), "component")).distinct()
