"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors are one row with a count.  The distinct ones are dealt into blocks, and every
pair of blocks meets in one task.  There the unit vectors are quantised to int8 with one
scale each; a tile's products of the integers are exact (float32 holds every integer that
occurs), and with e = |x - scale * q| the cosine of x and y lies within
e_x + (1 + e_x) * e_y of the quantised one.  Pairs surely above or below the threshold are
settled by that; only the pairs in between are computed in double precision.  A task hands on
link counts and a spanning forest of its links, never the pairs.

Scale: a block travels once per block, so the volume is (vectors x blocks); blocks grow to
``block`` vectors (fewer if these are long) before their number does.  Memory of a task is
two blocks and one tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.components import components
from flowrisk.llm.simhash import spanning
from flowrisk.session import stage

#: Rows and columns of a tile of products, and dimensions whose int8 products sum exactly in float32.
TILE, EXACT_DIMS = 1024, 1024
#: Components of a block's vectors at most (32 MB in double precision).
BLOCK_NUMBERS = 4 << 20
#: More than what rounding in double and float32 can add to a cosine.
SLACK = 1e-5


class Quantised:
    """Unit vectors, their int8 form, scales and error bounds."""

    def __init__(self, vectors: np.ndarray):
        # by a power of two, which is exact, so that squares neither overflow nor vanish
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
        self.unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.int8 = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        gap = self.unit - self.scale[:, None] * self.int8
        self.error = np.sqrt((gap * gap).sum(axis=1))

    def product(self, other: Quantised, i: slice, j: slice) -> np.ndarray:
        """Cosines of the quantised vectors of one tile."""
        a, b = self.int8[i], other.int8[j]
        total = 0
        for d in range(0, a.shape[1], EXACT_DIMS):
            total = total + a[:, d:d + EXACT_DIMS].astype(np.float32) @ b[:, d:d + EXACT_DIMS].astype(np.float32).T
        return total * self.scale[i, None] * other.scale[None, j]


def links_of(left: Quantised, right: Quantised, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine at or above the threshold, tile by tile."""
    for p in range(0, len(left.unit), TILE):
        i = slice(p, p + TILE)
        for q in range(0, len(right.unit), TILE):
            j = slice(q, q + TILE)
            near = left.product(right, i, j)
            bound = left.error[i, None] + (1 + left.error[i, None]) * right.error[None, j] + SLACK
            x, y = np.nonzero(near >= threshold - bound)
            if not len(x):
                continue
            sure = near[x, y] >= threshold + bound[x, y]
            x, y = x + p, y + q
            doubt = np.flatnonzero(~sure)
            for k in range(0, len(doubt), 1 << 16):
                d = doubt[k:k + (1 << 16)]
                sure[d] = np.einsum("ij,ij->i", left.unit[x[d]], right.unit[y[d]]) >= threshold
            yield x[sure], y[sure]


def pair_links(ids: np.ndarray, many: np.ndarray, vectors: np.ndarray, split: int | None, threshold: float):
    """Per vector of two blocks (or one, split None): links to the other, and its least mate."""
    both = Quantised(vectors)
    if split is None:
        left = right = both
        shift = 0
    else:
        left, right = Quantised(vectors[:split]), Quantised(vectors[split:])
        shift = split
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for x, y in links_of(left, right, threshold):
        y = y + shift
        if split is None:
            x, y = x[x < y], y[x < y]
        np.add.at(links, x, many[y])
        np.add.at(links, y, many[x])
        x, y = label[x], label[y]
        label = spanning(x, y, len(ids))[label]
    used = np.flatnonzero(links)
    return ids[used], links[used], ids[label[used]]


def cosine_groups(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9,
                  block: int = 32_768) -> DataFrame:
    """One row per vector: key, ``n_links``, ``component_id`` and ``kept``.

    Linked are all rows whose cosine is at least ``threshold``; equal vectors are linked.
    Null, empty and zero vectors, and those with a null, NaN or infinite component, link
    with nothing, and so do vectors of different lengths and rows without a key.  Repeated
    keys are vectors of their own.  Empty in, empty out; other columns are dropped.
    """
    v = F.col(vector)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, number) & F.exists(v, lambda x: x != 0)
    rows = stage(df.select(F.col(key).cast("long").alias("id"),
                           F.when(F.coalesce(good, F.lit(False)), v).alias("vector")), "vectors")
    classes = stage(rows.where("vector is not null").groupBy("vector")
                    .agg(F.min("id").alias("id"), F.count("*").alias("many"))
                    .withColumn("node", F.monotonically_increasing_id()), "classes")
    n, dims = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    block = min(block, max(64, BLOCK_NUMBERS // (dims or 1)))
    blocks = max(1, -(-n // block), min(8, n // 256))
    placed = classes.withColumn("block", F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = (placed.withColumn("other", others)
             .select(F.size("vector").alias("dims"), F.least("block", "other").alias("p"),
                     F.greatest("block", "other").alias("q"), "block", "node", "many", "vector"))

    def task(key_, table):
        p, q = key_[1].as_py(), key_[2].as_py()
        order = np.argsort(table["block"].to_numpy(), kind="stable")
        nodes, many = table["node"].to_numpy()[order], table["many"].to_numpy()[order]
        flat = table["vector"].combine_chunks()
        vectors = flat.flatten().to_numpy().astype(np.float64).reshape(len(nodes), -1)[order]
        split = None if p == q else int((table["block"].to_numpy() == p).sum())
        found = pair_links(nodes, many, vectors, split, threshold)
        return pa.table(dict(zip(("node", "links", "mate"), map(pa.array, found))))

    found = stage(dealt.groupBy("dims", "p", "q").applyInArrow(task, "node long, links long, mate long"), "cosine-links")
    group = components(found.select(F.col("node").alias("a"), F.col("mate").alias("b")))
    outside = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = (classes.join(outside, "node", "left").join(group, "node", "left")
              .withColumn("group", F.coalesce("component", "node")))
    least = member.groupBy("group").agg(F.min("id").alias("component_id"))
    by_class = member.join(least, "group").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    return (rows.join(by_class, "vector", "left")
            .select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False))))
