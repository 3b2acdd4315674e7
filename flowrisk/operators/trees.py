"""Boosted regression trees: fitted on counted cells of binned rows, scored by leaf marks (M3, M4).

The learner sees a row only through the bins of its features (MLlib takes 32 bins a feature, their
edges from about 10,000 rows), and squared loss needs no more of the rows of one cell (rows with
equal bins) than how many were drawn and the sum of their labels.  So the rows are read once, for
every round's own draw together, and all levels of all rounds go over the cells: one weighted MLlib
tree a round.  Labels within a cell add the same to the variance before and after any split, so
gains and splits are those of a fit on the rows.  With no two rows in a cell this costs what a fit
on the rows costs; with more it grows with the cells, not with the rows.

A tree of up to 64 leaves is scored without walking it: per feature and interval between thresholds
a word marks the leaves that are still open, the words of all features are and-ed, and the lowest
mark is the row's leaf.  Replacing one feature's value replaces one word.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk import session
from flowrisk.functions.columns import col
from flowrisk.session import drop_tables, spread, stage, staged_tables, tasks_needed

#: Depth whose leaves fit a word of marks.
DEPTH = 6
#: MLlib's number of bins a feature, and of rows for their edges.
BINS, EDGE_ROWS = 32, 10_000
#: Rounds whose draws a row carries at once.
ROUNDS_AT_ONCE = 20
#: Rows scored at once, so that their words stay in the processor's cache.
ROWS_AT_ONCE = 1 << 12
OPEN = np.uint64(2 ** 64 - 1)


def _first(marks: np.ndarray) -> np.ndarray:
    """Number of the lowest mark."""
    return np.bitwise_count(~marks & (marks - np.uint64(1)))


def _tree(node):
    """A fitted tree as nested (feature, threshold, left, right), its leaves as numbers; None with
    a split that is not by a threshold."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    split = node.split()
    if split.getClass().getSimpleName() != "ContinuousSplit":
        return None
    left, right = _tree(node.leftChild()), _tree(node.rightChild())
    return None if left is None or right is None else (split.featureIndex(), split.threshold(), left, right)


def _leaves(tree) -> list[float]:
    return [*_leaves(tree[2]), *_leaves(tree[3])] if isinstance(tree, tuple) else [tree]


def _splits(tree, at: int = 0) -> list[tuple]:
    """Per split its feature, its threshold and the range of the leaves on its left."""
    if not isinstance(tree, tuple):
        return []
    f, t, left, right = tree
    mid = at + len(_leaves(left))
    return [(f, t, at, mid), *_splits(left, at), *_splits(right, mid)]


class Trees:
    """Weighted sum of trees with up to 64 leaves each; rows come as one array a feature."""

    def __init__(self, trees: Sequence, weights: Sequence[float]):
        self.trees, self.weights = list(trees), list(weights)
        splits = [_splits(t) for t in self.trees]
        every = {f for s in splits for f, *_ in s}
        self.edges = {f: np.unique([t for s in splits for g, t, *_ in s if g == f]) for f in sorted(every)}
        self.marks = []
        for tree, its in zip(self.trees, splits, strict=True):
            words = {f: np.full(len(self.edges[f]) + 1, OPEN) for f in sorted({s[0] for s in its})}
            for f, t, a, b in its:      # x > t closes the leaves on the left; so does NaN, as in MLlib
                words[f][np.searchsorted(self.edges[f], t) + 1:] &= ~np.uint64((1 << b) - (1 << a))
            self.marks.append((words, np.array(_leaves(tree))))

    def _at(self, x: Sequence[np.ndarray]) -> dict[int, np.ndarray]:
        return {f: np.searchsorted(e, x[f]) for f, e in self.edges.items()}

    def predict(self, x: Sequence[np.ndarray]) -> np.ndarray:
        at, out = self._at(x), np.zeros(len(x[0]))
        for w, (words, values) in zip(self.weights, self.marks, strict=True):
            m = np.full(len(out), OPEN)
            for f, word in words.items():
                m &= word[at[f]]
            out += w * values[_first(m)]
        return out

    def permuted(self, x: Sequence[np.ndarray], other: Sequence[np.ndarray]) -> np.ndarray:
        """Predictions of the rows and, for each feature in turn, of the rows with the feature's
        values taken from ``other``: an array of 1 + features by rows."""
        at, to = self._at(x), self._at(other)
        out = np.zeros((1 + len(x), len(x[0])))
        for w, (words, values) in zip(self.weights, self.marks, strict=True):
            own = [word[at[f]] for f, word in words.items()]
            before = [np.full(out.shape[1], OPEN)]
            for m in own:
                before.append(before[-1] & m)
            add = w * values[_first(before[-1])]
            after = OPEN
            new = {}
            for i, (f, word) in reversed([*enumerate(words.items())]):
                new[f] = w * values[_first(before[i] & after & word[to[f]])]
                after = after & own[i]
            out[0] += add
            for f in range(len(x)):
                out[1 + f] += new.get(f, add)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the ``prediction`` of its ``features`` vector, as a model of MLlib gives it."""
        def score(batches):
            for b in batches:
                if b.num_rows:
                    x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(self.predict(x.T))], names=names)

        rest = df.drop("features")
        names = [*rest.columns, "prediction"]
        return df.select(*map(col, rest.columns), vector_to_array("features").alias("_x")) \
            .mapInArrow(score, rest.schema.add("prediction", "double"))


def of(model) -> Trees | None:
    """The trees of a fitted regressor; None if they are too large for marks."""
    if isinstance(model, Trees):
        return model
    trees = [_tree(t._call_java("rootNode")) for t in model.trees]
    if any(t is None or len(_leaves(t)) > 64 for t in trees):
        return None
    return Trees(trees, model.treeWeights)


def permuted_scores(trees: Trees, df: DataFrame, label: str, x: Sequence[str], other: Sequence[str]) -> DataFrame:
    """Per row and copy (0: as it is, i: the i-th feature from ``other``) the label and the prediction."""
    n = len(x)

    def score(batches):
        for b in batches:
            for k in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(k, ROWS_AT_ONCE)
                v = [c.to_numpy(zero_copy_only=False) for c in part.columns[1:]]
                p = trees.permuted(v[:n], v[n:]).T
                ends = np.arange(0, p.size + 1, n + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, p.ravel())], names=["y", "p"])

    wide = df.select(col(label).cast("double").alias("y"), *[col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*x, *other])])
    return wide.mapInArrow(score, "y double, p array<double>").select("y", F.posexplode("p").alias("copy", "prediction"))


def drawn(seed: int, row: str, share: float) -> Column:
    """Whether a seeded draw takes the row; it depends on the row's number alone."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(F.lit(seed), F.col(row)) < F.lit(int((share - 0.5) * 2.0 ** 64))


def edges_of(x: np.ndarray) -> np.ndarray:
    """Edges of a feature's bins as MLlib sets them: between all values, or nearest to equal counts."""
    v, c = np.unique(x[~np.isnan(x)], return_counts=True)
    between = (v[:-1] + v[1:]) / 2
    if len(between) < BINS:
        return between
    edges, seen, step = [], np.cumsum(c), c.sum() / BINS
    target = step
    for i in range(1, len(v)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            edges.append(between[i - 1])
            target += step
    return np.array(edges)


def _cells(batches, edges: list[np.ndarray]):
    """Label, draws and cell (one byte a feature, the number of its bin) of every row."""
    n = len(edges)
    for b in batches:
        y = b.column(0).to_numpy(zero_copy_only=False)
        if np.isnan(y).any():
            raise ValueError("labels must not be null or NaN")
        at = np.empty((len(y), n), np.uint8)
        for f, e in enumerate(edges):
            at[:, f] = np.searchsorted(e, b.column(2 + f).to_numpy(zero_copy_only=False))
        ends = np.arange(0, at.size + 1, n, dtype=np.int32)
        cell = pa.Array.from_buffers(pa.binary(), len(y), [None, pa.py_buffer(ends), pa.py_buffer(at.tobytes())])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cell], names=["y", "draws", "cell"])


def _bins(cell: pa.Array, n: int) -> np.ndarray:
    """Features by rows: the number of the bin, from 1."""
    at = b"".join(cell.to_pylist())
    return np.frombuffer(at, np.uint8).reshape(-1, n).T + 1.0


def fit(train: DataFrame, features: Sequence[str], label: str, row: str, rows: int, seed: int, max_iter: int,
        max_depth: int, subsampling: float = 0.8, subset: str = "0.8", step: float = 0.1) -> Trees:
    """M3 on ``rows`` (counted) rows: gradient boosting with squared loss, MLlib's bins, tree seeds
    and weights; ``row`` is a number of the row, from which each round draws its share of the rows."""
    n = len(features)
    wide = train.select(col(label).cast("double").alias("y"), col(row).cast("long").alias("row"),
                        *[col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])
    some = wide.where(drawn(seed - 1, "row", EDGE_ROWS / rows)).drop("y", "row").collect()
    seen = np.array(some, dtype=float).reshape(-1, n)
    edges = [edges_of(x) for x in seen.T]
    # rows of a cell that are too many for a task are summed in several
    kinds, many = np.unique(np.stack([np.searchsorted(e, x) for e, x in zip(edges, seen.T, strict=True)], 1).astype(np.uint8),
                            axis=0, return_counts=True)
    common = [k.tobytes() for k, c in zip(kinds, many, strict=True) if c * rows / len(seen) > session.ROWS_PER_TASK]

    def counted(first: int, last: int) -> DataFrame:
        draws = F.lit(0).cast("long")
        for m in range(first, last):
            draws = draws + F.when(drawn(seed + m, "row", subsampling), F.lit(1 << (m - first))).otherwise(F.lit(0)).cast("long")
        d = wide.select("y", draws.alias("draws"), *[f"_{i}" for i in range(n)])
        d = d.mapInArrow(lambda b: _cells(b, edges), "y double, draws long, cell binary")
        in_round = [(m, F.col("draws").bitwiseAND(F.lit(1 << (m - first)).cast("long")) != 0) for m in range(first, last)]
        sums = [x for m, i in in_round for x in (F.count_if(i).alias(f"n{m}"), F.sum(F.when(i, F.col("y"))).alias(f"s{m}"))]
        if not common:
            return spread(d, rows, "cell").groupBy("cell").agg(*sums)
        piece = F.when(F.col("cell").isin(common), F.pmod(F.xxhash64("draws", "y"), F.lit(tasks_needed(d.sparkSession, rows) or 8)))
        d = spread(d.withColumn("piece", F.coalesce(piece, F.lit(0).cast("long"))), rows, "cell", "piece")
        pieces = d.groupBy("cell", "piece").agg(*sums)
        return pieces.groupBy("cell").agg(*[F.sum(c).alias(c) for c in pieces.columns if c not in ("cell", "piece")])

    def target(so_far: Trees | None):
        def run(batches):
            for b in batches:
                x = _bins(b.column(0), n)
                w = b.column(1).to_numpy().astype(float)
                y = b.column(2).to_numpy() / w
                if so_far is not None and len(y):
                    y = 2 * (y - so_far.predict(x))
                ends = np.arange(0, x.size + 1, n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y), pa.array(w), pa.ListArray.from_arrays(ends, np.ascontiguousarray(x.T).ravel())], names=["label", "w", "x"])
        return run

    trees, weights = [], []
    with staged_tables() as own:
        for m in range(max_iter):
            if m % ROUNDS_AT_ONCE == 0:
                cells = stage(counted(m, min(max_iter, m + ROUNDS_AT_ONCE)), "cells")
                # MLlib looks at max(10,000, the square of this) rows for its edges: here at all cells, so at all bins
                bins = max(BINS, int(cells.count() ** 0.5) + 1)
            d = cells.where(F.col(f"n{m}") > 0).select("cell", f"n{m}", f"s{m}")
            d = d.mapInArrow(target(Trees(trees, weights) if trees else None), "label double, w double, x array<double>")
            one = RandomForestRegressor(numTrees=1, bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy=subset, weightCol="w",
                                        maxDepth=max_depth, maxBins=bins, seed=seed + m)
            d = d.select("label", "w", array_to_vector("x").alias("features")).persist()     # the fit reads it four times
            trees.append(_tree(one.fit(d).trees[0]._call_java("rootNode")))
            d.unpersist()
            weights.append(step if m else 1.0)
    drop_tables(train.sparkSession, own)

    def unbinned(t):
        return (t[0], edges[t[0]][int(t[1]) - 1], unbinned(t[2]), unbinned(t[3])) if isinstance(t, tuple) else t

    return Trees([unbinned(t) for t in trees], weights)
