"""Sharding by histogram sort.

Rows are ordered by a composite key (hash of the group, tie-break) and cut into shards of
nearly equal weight.  Splitters come from a histogram sort: exact weights below a set of
probe keys are counted over all partitions, each splitter's bracket is narrowed to the
probes around its target, and the rounds go on until every splitter meets its tolerance.
Only a narrow staged table (key, tie-break, weight) is read in the rounds.  The rows
themselves move once, to cells (fixed fractions of a shard), and get their place there.

Scale: a round sends (probes + 1) sums per partition, reduced by a grouped sum; the driver
sees one sum per interval.  A hot group (equal texts) is one key value, so its splitters are
refined on the tie-break inside it and it spreads over as many cells as its weight needs.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowrisk.llm.common import free_name, partitions
from flowrisk.session import stage

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: A boundary in key order: the first (key, tie) that belongs above it.
Edge = tuple[int, int]
#: Cells of all shards together, and probes of a round while few splitters are pending.
MOST_CELLS, MOST_PROBES = 16384, 32768


def interval_of(edges: list[Edge], key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Per row: how many of the sorted edges are at or below its (key, tie)."""
    edge_key = np.array([e[0] for e in edges], np.int64)
    edge_tie = np.array([e[1] for e in edges], np.int64)
    first = np.searchsorted(edge_key, key, "left")
    last = np.searchsorted(edge_key, key, "right")
    out = first.copy()
    on_edge = np.flatnonzero(last > first)
    for a in np.unique(first[on_edge]):
        rows = on_edge[first[on_edge] == a]
        out[rows] = a + np.searchsorted(edge_tie[a:last[rows[0]]], tie[rows], "right")
    return out


def weights_between(narrow: DataFrame, edges: list[Edge]) -> dict[int, int]:
    """Exact weight of every interval between the edges (one pass, sums only)."""
    n = len(edges) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            key, tie, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tie", "weight"))
            np.add.at(total, interval_of(edges, key, tie), w)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["at", "weight"])

    sums = narrow.mapInArrow(count, "at int, weight long").groupBy("at").agg(F.sum("weight").alias("weight"))
    return {r["at"]: r["weight"] for r in sums.collect()}  # one row per interval


class Splitter:
    """One boundary being narrowed: weights below its bracket's two ends are known."""

    def __init__(self, target: float, tolerance: float, group_slack: float, total: int, ties: tuple[int, int]):
        self.target, self.tolerance, self.group_slack, self.ties = target, tolerance, group_slack, ties
        self.low, self.high = (LOW, LOW), (HIGH, HIGH)
        self.below_low, self.below_high = 0, total
        self.edge: Edge | None = None
        self.settle()

    def nearest(self) -> tuple[float, Edge]:
        a, b = self.target - self.below_low, self.below_high - self.target
        return (a, self.low) if a <= b else (b, self.high)

    def settle(self) -> None:
        gap, edge = self.nearest()
        one_key = self.low[0] == self.high[0] or self.high == (self.low[0] + 1, LOW)
        whole = one_key and edge[1] == LOW and gap <= self.group_slack
        if gap <= self.tolerance or whole or not self.probes(1):
            self.edge = edge

    def probes(self, n: int) -> list[Edge]:
        """Up to about n keys inside the bracket; tie-breaks once it holds one key."""
        (k0, t0), (k1, t1) = self.low, self.high
        if k1 - k0 > 1 or (k1 - k0 == 1 and t1 != LOW):
            return [(k, LOW) for k in range(k0 + 1, k1 + (t1 != LOW), max(1, (k1 - k0) // (n + 1)))]
        first, top = max(t0, self.ties[0]) + 1, t1 if k1 == k0 else self.ties[1] + 1
        return [(k0, t) for t in range(first, top, max(1, (top - first) // (n + 1)))]

    def narrow(self, edges: list[Edge], below: list[int]) -> None:
        i = bisect_right(below, self.target)
        if i > 0 and edges[i - 1] > self.low:
            self.low, self.below_low = edges[i - 1], below[i - 1]
        if i < len(edges) and edges[i] < self.high:
            self.high, self.below_high = edges[i], below[i]
        self.settle()


def find_splitters(narrow: DataFrame, targets: list[tuple[float, float, float]], total: int,
                   ties: tuple[int, int]) -> list[Edge]:
    """Boundaries for (target weight below, tolerance, slack to keep a key whole).

    ``ties``: the least and the largest tie-break.
    """
    found = [Splitter(*t, total, ties) for t in targets]
    while pending := [s for s in found if s.edge is None]:
        probes = min(512, max(16, MOST_PROBES // len(pending)))
        edges = sorted({e for s in pending for e in s.probes(probes)})
        sums = weights_between(narrow, edges)
        below = np.cumsum([sums.get(i, 0) for i in range(len(edges))]).tolist()
        for s in pending:
            s.narrow(edges, below)
    return [s.edge for s in found]


def histogram_shards(df: DataFrame, shards: int, *, group: Column, tie: str, weight: Column,
                     tolerance: float = 0.002, group_slack: float = 0.05,
                     cell_weight: int = 16 << 20) -> DataFrame:
    """``df`` plus ``weight``, ``shard`` (0 .. shards-1) and ``slot`` (gapless per shard).

    Shards are contiguous in the order (hash of ``group``, ``tie``) and their weights differ
    from the ideal by at most ``tolerance`` of it, or by part of one row where rows are
    larger than that.  A group of equal values stays in one shard unless keeping it whole
    would move a boundary by more than ``group_slack`` of a shard.  ``tie`` is a long column;
    nulls sort first.  Repeated rows get places of their own.  An empty frame gives an empty
    frame.  Input columns keep their names (helper columns avoid clashes); a clashing
    ``weight``, ``shard`` or ``slot`` column is replaced.
    """
    spark = df.sparkSession
    df = df.drop("weight", "shard", "slot")
    k, t, c, rows = (free_name(df, n) for n in ("_key", "_tie", "_cell", "_rows"))
    keyed = (df.withColumn("weight", weight.cast("long"))
             .withColumn(k, F.xxhash64(group)).withColumn(t, F.coalesce(F.col(tie).cast("long"), F.lit(LOW))))
    narrow = stage(keyed.select(F.col(k).alias("key"), F.col(t).alias("tie"), "weight"), "shard-keys")
    total, *ties = narrow.agg(F.sum("weight"), F.min("tie"), F.max("tie")).first()
    total, ties = total or 0, (ties[0] or 0, ties[1] or 0)
    per_shard = total / shards
    cells = min(max(1, math.ceil(per_shard / cell_weight)), max(1, MOST_CELLS // shards))
    targets = [(total * i / (shards * cells),
                (tolerance if i % cells == 0 else 0.2 / cells) * per_shard,
                (group_slack if i % cells == 0 else 0.2 / cells) * per_shard)
               for i in range(1, shards * cells)]
    edges = sorted(find_splitters(narrow, targets, total, ties))

    @pandas_udf("int")
    def cell_of(key, tie_):
        import pandas as pd
        return pd.Series(interval_of(edges, key.to_numpy(), tie_.to_numpy()).astype(np.int32))

    sizes = (narrow.select(cell_of("key", "tie").alias(c)).groupBy(c).agg(F.count("*").alias(rows))
             .withColumn("shard", (F.col(c) / cells).cast("int")))
    before = sizes.withColumn(rows, F.sum(rows).over(Window.partitionBy("shard").orderBy(c)) - F.col(rows))
    place = F.row_number().over(Window.partitionBy(c).orderBy(k, t))
    moved = (keyed.withColumn(c, cell_of(k, t)).repartition(partitions(spark), c).withColumn("slot", place)
             .join(before, c))
    return (moved.withColumn("slot", (F.col("slot") - 1 + F.col(rows)).cast("long"))
            .select(*df.columns, "weight", "shard", "slot"))
