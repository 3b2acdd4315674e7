"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints are dealt into tiles by the population counts of their blocks (two
halves, or four quarters where the corpus is large enough to fill those).  Two fingerprints
within ``radius`` bits have block counts that differ by at most ``radius`` in total, so a
tile meets only the tiles of neighbouring counts; all other tile pairs are skipped.  A tile
pair is compared exactly with numpy's exclusive-or and bit counts, and hands on at most one
link per fingerprint (a spanning forest of its matches), so a group of near copies costs no
more than its members.  Components of the links give the groups.

Scale: equal fingerprints (copies, however many) are one row before any comparison.  Tiles
move once for each neighbouring count vector, a fixed number; compared pairs still grow
with the square of the distinct fingerprints, cut by the counts (see the README's figures).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.llm.common import free_name, map_column, raw_texts
from flowrisk.llm.components import components
from flowrisk.session import stage

#: Shingles whose hashes are counted at once.
AT_ONCE = 1 << 16


def fingerprint(raw: bytes, shingle: int, seed: int) -> int:
    """Majority of the bits of the shingles' XXH64; signed, 0 for a text without words."""
    from xxhash import xxh64_digest
    words = raw.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    k = min(shingle, len(words))
    start, end = start[:len(words) - k + 1].tolist(), end[k - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(start), AT_ONCE):
        digests = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(start[i:i + AT_ONCE], end[i:i + AT_ONCE])])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(start)).tobytes(), "big", signed=True)


def simhash(df: DataFrame, text: str = "text", *, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``df`` with ``fingerprint`` (long, the 64 bits) in place of the text.

    Texts are split and lower-cased as ASCII; null, empty and blank texts get 0.
    """
    return map_column(df, text, "fingerprint", T.LongType(), lambda: lambda raw: fingerprint(raw, shingle, seed),
                      raw_texts)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least connected node of each of n nodes, for links a[i] - b[i]."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def matches(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints within the radius."""
    found = []
    for i in range(0, len(left), 256):
        hit = np.bitwise_count(left[i:i + 256, None] ^ right[None, :]) <= radius
        if hit.any():
            x, y = np.nonzero(hit)
            found.append((x + i, y))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*found))


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the matches of two tiles, or within one (right is None)."""
    x, y = matches(left, left if right is None else right, radius)
    if right is None:
        x, y = x[x < y], y[x < y]
        both = left
    else:
        y = y + len(left)
        both = np.concatenate([left, right])
    if not len(x):
        return both[:0], both[:0]
    used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    label = spanning(at[:len(x)], at[len(x):], len(used))
    child = np.flatnonzero(label != np.arange(len(used)))
    return both[used[child]], both[used[label[child]]]


def _neighbours(blocks: int, radius: int) -> list[tuple[int, ...]]:
    """Count differences to visit once per unordered pair; the zero vector is among them."""
    return [d for d in product(range(-radius, radius + 1), repeat=blocks)
            if sum(map(abs, d)) <= radius and d >= (0,) * blocks]


def close_pairs(distinct: DataFrame, radius: int, *, tile: int = 2048) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints of ``distinct`` within the radius."""
    n = distinct.count()
    blocks = 2 if n < 4 << 20 else 4
    salts = max(1, -(-n // (4 << 20)))
    width = 64 // blocks
    mask = (1 << width) - 1
    cell = F.array(*[F.bit_count(F.shiftrightunsigned("fingerprint", i * width).bitwiseAND(F.lit(mask)))
                     .cast("int") for i in range(blocks)])
    celled = distinct.select("fingerprint", cell.alias("cell"))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    tiles = (celled.join(sizes, "cell")
             .withColumn("no", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
             .groupBy("cell", "no").agg(F.collect_list("fingerprint").alias("prints")))  # about `tile` of them
    tiles = stage(tiles, "tiles")
    steps = F.explode(F.array(*[F.array(*map(F.lit, d)) for d in _neighbours(blocks, radius)]))
    left = (tiles.select("cell", F.col("no").alias("no_a"), F.col("prints").alias("left"), steps.alias("step"))
            .withColumn("other", F.zip_with("cell", "step", lambda a, b: a + b))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    right = tiles.select(F.col("cell").alias("other"), F.col("no").alias("no_b"), F.col("prints").alias("right"),
                         F.pmod("no", F.lit(salts)).alias("salt"))
    same = F.col("cell") == F.col("other")
    pairs = (left.join(right, ["other", "salt"]).where(~same | (F.col("no_a") <= F.col("no_b")))
             .select("left", F.when(same & (F.col("no_a") == F.col("no_b")), F.lit(None))
                     .otherwise(F.col("right")).alias("right")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                right_ = y.values.to_numpy().view(np.uint64) if y.is_valid else None
                a, b = tile_links(x.values.to_numpy().view(np.uint64), right_, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, *, key: str = "doc_id", radius: int = 4) -> DataFrame:
    """Groups of rows whose ``fingerprint`` (long) links them within ``radius`` bits.

    Adds ``component_id`` (the least key that can be reached, itself included) and ``kept``
    (true for exactly one row of each group: the least key, the first row where keys repeat).
    Rows with a null key take part; they are kept only where no other row of the group has a
    key.  Empty in, empty out; existing columns of these names are replaced.
    """
    df = df.drop("component_id", "kept")
    row = free_name(df, "_row")
    rows = stage(df.withColumn(row, F.monotonically_increasing_id()), "prints")
    first = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row"))
    distinct = rows.groupBy("fingerprint").agg(F.min(first).alias("first"))
    groups = components(close_pairs(distinct, radius)).withColumnRenamed("node", "fingerprint")
    member = distinct.join(groups, "fingerprint", "left").withColumn("group", F.coalesce("component", "fingerprint"))
    best = member.groupBy("group").agg(F.min("first").alias("_best"))
    of_print = stage(member.join(best, "group").select(F.col("fingerprint"), "_best"), "groups")
    return (rows.join(of_print, "fingerprint")
            .select(*df.columns, F.col("_best.key").alias("component_id"), (F.col(row) == F.col("_best.row")).alias("kept")))
