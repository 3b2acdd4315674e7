"""Interaction audit of document filters by truth-table survival words.

With k filters (five at most) a document's survival word has one bit for each of the 2^k
subsets of filters: set if the document passes all filters of the subset.  Carry-save adders
sum these words bit by bit (positional popcounts), so that one pass gives the survivors of
every subset, per part and label.  The effects of every order of the filters follow from
these counts alone: what a step keeps and removes, and a filter's mean share over all orders.

Scale: a row travels as (key, part, failed bits, text digest) twice, to find the first of equal
texts and its labels, never with its text; counts are summed within a task before they are
shuffled, 2^k numbers a part and label.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import raw_texts

#: Characters of which a text with filter D holds none.
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(65, 91))


def survival_words(failed: np.ndarray, k: int) -> np.ndarray:
    """Bit s of a word is set if no filter of subset s is among the failed ones."""
    table = np.array([sum(1 << s for s in range(1 << k) if not f & s) for f in range(1 << k)], np.uint32)
    return table[failed]


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits, by carry-save adders.

    Three words of one weight become a sum word of that weight and a carry word of the next,
    until two at most are left of each weight.
    """
    total = np.zeros(32, np.int64)
    own, weight = words.astype(np.uint32), 0
    while len(own):
        carries = [own[:0]]
        while len(own) > 2:
            m = len(own) // 3
            a, b, c = own[:m], own[m:2 * m], own[2 * m:3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            own = np.concatenate([half ^ c, own[3 * m:]])
        total += ((own[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64) << weight
        own, weight = np.concatenate(carries), weight + 1
    return total


def survivors(df: DataFrame, k: int, *, part: str = "part", failed: str = "failed", labels: tuple[str, ...] = ()) -> DataFrame:
    """``(part, label, subset, n)``: rows that pass all filters of each subset (a bit mask).

    ``failed`` holds the bits of the filters that a row fails; ``label`` is ``all`` or one of
    ``labels`` (boolean columns; null is false).  Empty in, empty out.
    """
    names = ("all", *labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(0).dictionary_encode()
            at, values = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary
            words = survival_words(b.column(1).to_numpy(zero_copy_only=False), k)
            has = [np.ones(len(at), bool)] + [c.fill_null(False).to_numpy(zero_copy_only=False) for c in b.columns[2:]]
            who, label, subset, n = [], [], [], []
            for p in range(len(values)):
                own = at == p
                for name, mask in zip(names, has):
                    who += [p] * (1 << k)
                    label += [name] * (1 << k)
                    subset += range(1 << k)
                    n += positional_counts(words[own & mask])[:1 << k].tolist()
            yield pa.RecordBatch.from_arrays([values.take(pa.array(who, pa.int64())), pa.array(label, pa.string()),
                                              pa.array(subset, pa.int32()), pa.array(n, pa.int64())],
                                             ["part", "label", "subset", "n"])

    rows = df.select(F.col(part).alias("part"), F.col(failed).cast("int").alias("failed"), *labels)
    return (rows.mapInArrow(run, "part string, label string, subset int, n long")
            .groupBy("part", "label", "subset").agg(F.sum("n").alias("n")))


def order_effects(counts: DataFrame, filters: str, labels: dict[str, str]) -> DataFrame:
    """What every filter does at its step, in every order of ``filters`` (one letter each).

    ``counts`` is what ``survivors`` gives; ``labels`` names the column of removed rows for each
    label.  One row per part, ``filter_order`` and ``step`` (from 1), zeros included: ``kept``,
    ``removed``, ``redundant`` (fail the filter, removed earlier), ``unique_fails`` (fail it
    alone), the label columns, and ``shapley``: rows the filter removes, over all orders.
    """
    k = len(filters)
    everything = (1 << k) - 1
    orders = ["".join(o) for o in permutations(filters)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = {name: np.zeros(1 << k, np.int64) for name in ("all", *labels)}
                for x in found:
                    n[x["label"]][x["subset"]] = x["n"]
                whole = n["all"]
                shapley = {c: sum(factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * int(whole[s] - whole[s | 1 << i])
                                  for s in range(1 << k) if not s >> i & 1) for i, c in enumerate(filters)}
                rows = []
                for order in orders:
                    before = 0
                    for step, c in enumerate(order, 1):
                        bit = 1 << filters.index(c)
                        after = before | bit
                        removed = int(whole[before] - whole[after])
                        rows.append((part, order, step, int(whole[after]), removed, int(whole[0] - whole[bit]) - removed,
                                     int(whole[everything & ~bit] - whole[everything]),
                                     *(int(n[x][before] - n[x][after]) for x in labels), shapley[c]))
                        before = after
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *labels.values(), "shapley"]
    kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * (len(names) - 3)
    schema = pa.schema(list(zip(names, kinds)))
    spark_schema = ", ".join(f"{c} {'string' if t == pa.string() else 'int' if t == pa.int32() else 'long'}"
                             for c, t in zip(names, kinds))
    lists = counts.groupBy("part").agg(F.collect_list(F.struct("label", "subset", "n")).alias("found"))
    return lists.mapInArrow(run, spark_schema)


def text_failures(raw: bytes, points: int) -> int:
    """Bits of the filters A to D that a text fails; see ``filter_failures``."""
    words = raw.split()  # bytes: only ASCII white space splits
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * points) << 2 \
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3


def filter_failures(df: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(key, part, failed)`` of each row: bits 0 to 4 for the filters A to E that it fails.

    A: under 200 words; B: under half of the words are distinct; C: over 3 % of the code points
    are A-Z; D: holds any of ``#$%&*|``; E: the text is that of a row with a smaller key (by
    SHA-256).  Null texts are empty texts, null parts the empty string; a null key is not smaller
    than any, nor any smaller than it; repeated rows count each.
    """
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        for b in batches:
            raws = raw_texts(b.column(2))
            points = pc.utf8_length(b.column(2)).fill_null(0).to_pylist()
            failed = pa.array([text_failures(r, p) for r, p in zip(raws, points)], pa.int32())
            digest = pa.array([sha256(r).digest() for r in raws], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), failed, digest], ["key", "part", "failed", "digest"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                     F.col(text).alias("text"))
    rows = rows.mapInArrow(run, "key long, part string, failed int, digest binary")
    first = rows.where("key is not null").groupBy("digest").agg(F.min("key").alias("key"))
    first = first.withColumn("first", F.lit(True))
    later = F.col("key").isNotNull() & F.col("first").isNull()
    return (rows.join(first, ["key", "digest"], "left")
            .select("key", "part", (F.col("failed") + F.when(later, 16).otherwise(0)).alias("failed")))


def audit_filters(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``order_effects`` of the filters A to E of ``filter_failures`` over the rows of ``df``.

    ``labels`` (key, quality, toxic) covers some keys; repeated ones count as any of their rows
    says.  Removed rows with quality 1 are ``good_lost``, with toxic 1 ``toxic_lost``.  Other
    columns of either table play no part; empty in, empty out.
    """
    flags = filter_failures(df, key=key, text=text, part=part)
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = flags.join(known, "key", "left")
    return order_effects(survivors(rows, 5, labels=("good", "toxic")), "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})
