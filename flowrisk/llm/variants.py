"""Spelling variants of a vocabulary by a reduced alphabet.

Letters are hashed to a few symbols, so a word becomes a reduced word of the same length.  Two
words that differ by one inserted, deleted or replaced character have reduced words that are
equal or differ by one such edit.  Each word's full one-edit neighbourhood in the reduced
alphabet is generated (numpy arithmetic on polynomial hashes, no strings), joined with the
reduced vocabulary, and verified on the original words.

Scale: neighbours that no reduced word can have are dropped where they are made, by a bit map of
the reduced vocabulary.  Its size is fixed by ``MOST_BITS`` whatever the vocabulary; beyond
that it only lets more neighbours through to the join, which decides.  Nothing else is
collected.  Words of a reduced word are never held together, they meet in the join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import raw_texts
from flowrisk.session import stage

#: Maximal runs of letters (A-Z are lower-cased before; U+00C0 to U+00FF are two bytes).
RUNS = rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}"
#: Base of the hash of a reduced word, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Bits of the map of reduced words, at most (as a power of two), and bits of one of its pieces.
MOST_BITS, PIECE_BITS = 28, 16
#: Different words that a task counts before it hands them on.
AT_ONCE = 200_000


def count_runs(df: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 7,
               every: int = 31) -> DataFrame:
    """``(word, n)``: the letter runs of all texts with at least ``least`` code points.

    Of each run whose crc32 of ``<key>:<run>`` (key null: empty) ``every`` divides, one code
    point is deleted, at crc32 % length.  Null texts have no runs; repeated rows count each.
    """
    pattern = re.compile(RUNS % least)

    def found(raw: bytes) -> Counter:
        if len(raw) <= 4 << 20:
            return Counter(pattern.findall(raw))
        return Counter(m[0] for m in pattern.finditer(raw))

    def out(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                          ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), raw_texts(b.column(1))):
                head = crc32(f"{'' if k is None else k}:".encode())
                for own, n in found(raw.lower()).items():  # bytes: only A-Z change
                    h, word = crc32(own, head), own.decode()
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) >= AT_ONCE:
                    yield out(total)
                    total = {}
        if total:
            yield out(total)

    runs = df.select(key, text).mapInArrow(run, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n"))


def symbols_of(words: list[str], symbols: int) -> np.ndarray:
    """Symbols 1 to ``symbols`` of equally long words, one row each."""
    points = np.array(words, f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    h = (points * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    h ^= h >> np.uint64(15)
    return (h * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF)) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def reduced_hash(sym: np.ndarray) -> np.ndarray:
    """One 64-bit number a reduced word."""
    return (sym * _powers(sym.shape[1])[:sym.shape[1]]).sum(axis=1, dtype=np.uint64)


def neighbourhood(sym: np.ndarray, symbols: int) -> np.ndarray:
    """Numbers of every reduced word's one-edit neighbours and of itself, one row each."""
    k, n = sym.shape
    power = _powers(n + 1)
    sums = np.concatenate([np.zeros((k, 1), np.uint64), np.cumsum(sym * power[:n], axis=1, dtype=np.uint64)], axis=1)
    whole = sums[:, -1:]
    each = np.arange(1, symbols + 1, dtype=np.uint64)
    replaced = whole[:, :, None] + (each[None, None, :] - sym[:, :, None]) * power[None, :n, None]
    deleted = sums[:, :n] + (whole - sums[:, 1:]) * np.uint64(_BACK)
    inserted = (sums + (whole - sums) * np.uint64(_BASE))[:, :, None] + each[None, None, :] * power[None, :n + 1, None]
    return np.concatenate([replaced.reshape(k, -1), deleted, inserted.reshape(k, -1)], axis=1)


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    """Place of a number in a map of 2 ** bits bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    size = np.array([len(w) for w in words])
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        yield at, [words[i] for i in at.tolist()]


def reduced(words: DataFrame, symbols: int) -> DataFrame:
    """``words`` (word, n) with ``h``, the number of the reduced word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            h = np.zeros(len(own), np.uint64)
            for at, same in _by_length(own):
                h[at] = reduced_hash(symbols_of(same, symbols))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h.view(np.int64))], ["word", "n", "h"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, h long")


def bit_map(words: DataFrame, bits: int) -> np.ndarray:
    """The map of all ``h``, 2 ** bits bits packed in bytes; pieces of it are merged by Spark."""
    piece = min(PIECE_BITS, bits)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_slot(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> piece).astype(np.int32)),
                                              pa.array((at & ((1 << piece) - 1)).astype(np.int32))], ["piece", "at"])

    def merge(table):
        own = np.zeros(1 << piece, np.uint8)
        own[table["at"].to_numpy()] = 1
        return pa.table({"piece": pa.array([table["piece"][0].as_py()], pa.int32()),
                         "own": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    pieces = words.select("h").mapInArrow(slots, "piece int, at int").groupBy("piece").applyInArrow(
        merge, "piece int, own binary")
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    width = max(1, (1 << piece) // 8)
    for r in pieces.toLocalIterator():  # 2 ** (bits - piece) rows at most
        out[r["piece"] * width:(r["piece"] + 1) * width] = np.frombuffer(r["own"], np.uint8)
    return out


def near_words(words: DataFrame, symbols: int = 16) -> DataFrame:
    """``(word, near, near_n)``: the pairs of ``words`` (word, n; distinct words) one edit apart, both ways."""
    spark = words.sparkSession
    coded = stage(reduced(words, symbols), "reduced")
    bits = min(MOST_BITS, max(6, (32 * coded.count()).bit_length()))
    known = spark.sparkContext.broadcast(bit_map(coded, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = known.value
        for b in batches:
            for start in range(0, len(b), 4096):
                own = b.column(0).slice(start, 4096).to_pylist()
                for at, same in _by_length(own):
                    for i in range(0, len(same), max(1, (1 << 21) // (2 * symbols * (len(same[0]) + 1)))):
                        some = same[i:i + max(1, (1 << 21) // (2 * symbols * (len(same[0]) + 1)))]
                        h = neighbourhood(symbols_of(some, symbols), symbols)
                        slot = _slot(h, bits)
                        row, col = np.nonzero((bit[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                        h = h[row, col]
                        order = np.lexsort((h, row))
                        row, h = row[order], h[order]
                        new = np.ones(len(row), bool)
                        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                        words_ = pa.array(some, pa.string()).take(pa.array(row[new]))
                        yield pa.RecordBatch.from_arrays([words_, pa.array(h[new].view(np.int64))], ["word", "h"])

    made = coded.select("word").mapInArrow(run, "word string, h long")
    other = coded.select("h", F.col("word").alias("near"), F.col("n").alias("near_n"))
    one_edit = (F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    return made.join(other, "h").where(one_edit).select("word", "near", "near_n")


def spelling_forms(words: DataFrame, *, ratio: int = 10, symbols: int = 16) -> DataFrame:
    """``words`` (word, n) with ``n_near``, ``form``, ``form_n`` and ``root``.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point.
    The form is the near word of largest n (ties: the least), if that is at least ``ratio`` times
    the word's own; else null.  The root is where the forms lead, the word itself without one.
    Words without near words have ``n_near`` 0.  Words must be distinct and not null; other
    columns are dropped; empty in, empty out.
    """
    words = stage(words.select("word", "n"), "words")
    best = near_words(words, symbols).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    large = -F.col("best.less") >= ratio * F.col("n")
    out = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")), "forms")
    links = out.where("form is not null").select("word", F.col("form").alias("root"))
    steps, most = 0, out.agg(F.max("n")).first()[0] or 0
    while most >= ratio > 1:  # every step of a chain is that much more frequent
        steps, most = steps + 1, most // ratio
    reach = 1
    while reach < steps:  # pointer jumping
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stage(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    return out.join(links, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
