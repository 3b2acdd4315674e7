"""Packing documents into fixed-length sequences: dominance reduction, then best fit.

Documents become token pieces of at most a sequence's length.  Only the histogram of piece
lengths (one count per length, so at most ``capacity`` numbers however large the corpus) is
packed on the driver: the Martello-Toth reduction fixes the document sets {j}, {j, k} and
{j, k, l} that dominate every other set holding j, all copies of a length at once; the rest
goes best fit, longest first.  The plan says which ranks of a length go to which run of
sequences and at which offset; pieces get their rank within their length from bucket counts,
so no length, however common, meets in one task.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.llm.common import Memo, partitions, texts
from flowrisk.llm.counts import read_spec
from flowrisk.session import stage

def plain(word: str) -> bool:
    """Latin letters only, each composed and with one letter as its lower case (not U+0130)."""
    return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word


#: The byte-level alphabet: visible bytes stand for themselves, the others for 256 and up, in order.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The word tokenizer drops white space, so words encode by themselves; each worker keeps a
    bounded memo of them.  It also lower-cases, and parts a full stop or comma from a Latin
    letter before it: such words are put together from the memo.  Words of lower-case Latin letters
    are one pre-token and unchanged by the normaliser, so they go straight to the BPE model,
    as the byte-level characters of their UTF-8.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_str(spec)
        self.merge = self.model.model.tokenize
        self.memo = Memo(self.of_word)
        self.memo[""] = b""

    def of_word(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in ".," and plain(word[-2]):
            return self.memo[word[:-1]] + self.memo[word[-1]]
        if plain(word):
            low = word.lower()
            if low != word:
                return self.memo[low]
            piece = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS)
            ids = [t.id for t in self.merge(piece)]
        else:
            ids = self.model.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.memo.__getitem__, words))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(spec: str) -> WordIds:
    """One encoder per Python worker and tokenizer, kept between tasks."""
    if spec not in _WORD_IDS:
        _WORD_IDS[spec] = WordIds(spec)
    return _WORD_IDS[spec]


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int, *, key: str = "doc_id", text: str = "text",
                 end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: key, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``).

    A document is its ids followed by ``end_id``; only one longer than ``capacity`` is cut,
    into pieces of that length and a shorter last one.  A null or empty text is ``end_id``.
    ``ids`` (binary, little-endian unsigned 32-bit) comes with ``keep_ids``.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    end = np.array([end_id], "<u4").tobytes()
    kinds = [("piece", pa.int32(), T.IntegerType()), ("start", pa.int64(), T.LongType()),
             ("length", pa.int64(), T.LongType()), ("ids_crc32", pa.int64(), T.LongType())]
    if keep_ids:
        kinds.append(("ids", pa.binary(), T.BinaryType()))
    schema = T.StructType([df.schema[key]] + [T.StructField(n, t) for n, _, t in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, width = word_ids(spec.value), 4 * capacity
        for b in batches:
            row, rows = [], []
            for i, t in enumerate(texts(b.column(1))):
                ids = model.encode(t) + end
                for k in range(0, len(ids), width):
                    part = ids[k:k + width]
                    row.append(i)
                    rows.append((k // width, k // 4, len(part) // 4, zlib.crc32(part), part)[:len(kinds)])
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int32()))]
                + [pa.array(c, t) for c, (_, t, _) in zip(columns, kinds)], [key, *(n for n, _, _ in kinds)])

    return df.select(key, text).mapInArrow(run, schema)


class Plan:
    """Open sequences by room left, as runs (first sequence, how many), and what went where."""

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity, self.left = capacity, dict(counts)
        self.used: dict[int, int] = defaultdict(int)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.sequences = 0
        self.moves: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)

    def put(self, size: int, many: int, first: int, room: int) -> None:
        """``many`` pieces of ``size``, one into each sequence from ``first``, with ``room`` left there."""
        self.moves[size].append((self.used[size], many, first, self.capacity - room))
        self.used[size] += many
        self.left[size] -= many

    def leave(self, room: int, first: int, many: int) -> None:
        if room and many:
            if not self.runs[room]:
                self.rooms.insert(bisect_left(self.rooms, room), room)
            self.runs[room].append((first, many))

    def fix(self, sizes: list[int], many: int) -> None:
        """``many`` new sequences that each hold one piece of every size."""
        room = self.capacity
        for s in sizes:
            self.put(s, many, self.sequences, room)
            room -= s
        self.leave(room, self.sequences, many)
        self.sequences += many

    def present(self) -> list[int]:
        return sorted(s for s, n in self.left.items() if n)

    def reduce(self) -> None:
        """Fix dominating sets until a pass over all lengths finds none."""
        changed = True
        while changed:
            changed = False
            for s in reversed(self.present()):
                while self.left[s] and (found := self.dominating(s)):
                    need = {x: found.count(x) for x in found}
                    self.fix(found, min(self.left[x] // n for x, n in need.items()))
                    changed = True

    def dominating(self, s: int) -> list[int] | None:
        """A set with a piece of ``s`` that can stand for any other such set, or None."""
        sizes = self.present()
        others = [x for x in sizes if self.left[x] - (x == s) > 0]
        room = self.capacity - s
        fits = others[:bisect_right(others, room)]
        if not fits:
            return [s]
        top = fits[-1]
        if top == room:
            return [s, top]
        left = lambda x: self.left[x] - (x == s)
        small = [x for x in fits[:3] for _ in range(min(3, left(x)))]
        if sum(small[:2]) > room or len(small) < 2:
            return [s, top]
        if sum(small[:3]) <= room and len(small) > 2:
            return None
        # at most two others fit: the largest pair sum, and the largest lesser piece of a pair
        best, lesser, j = 0, 0, len(fits) - 1
        for i, y in enumerate(fits):
            while j >= i and (y + fits[j] > room or (i == j and left(y) < 2)):
                j -= 1
            if j < i:
                break
            best, lesser = max(best, y + fits[j]), y
        if best <= top:
            return [s, top]
        k = bisect_right(fits, room - top) - 1
        if k >= 0 and fits[k] == top and left(top) < 2:
            k -= 1
        if k >= 0 and fits[k] >= lesser:
            return [s, top, fits[k]]
        return None

    def best_fit(self) -> None:
        for s in reversed(self.present()):
            while self.left[s]:
                at = bisect_left(self.rooms, s)
                if at == len(self.rooms):
                    self.open(s)
                    continue
                room = self.rooms[at]
                first, many = self.runs[room].pop()
                n = min(many, self.left[s])
                if n < many:
                    self.runs[room].append((first + n, many - n))
                if not self.runs[room]:
                    self.rooms.pop(at)
                self.put(s, n, first, room)
                self.leave(room - s, first, n)

    def open(self, s: int) -> None:
        """New sequences for all pieces of ``s`` that are left, each filled with as many as fit."""
        each = self.capacity // s
        full, last = divmod(self.left[s], each)
        for depth in range(each):
            if full:
                self.put(s, full, self.sequences, self.capacity - depth * s)
            if depth < last:
                self.put(s, 1, self.sequences + full, self.capacity - depth * s)
        self.leave(self.capacity - each * s, self.sequences, full)
        if last:
            self.leave(self.capacity - last * s, self.sequences + full, 1)
        self.sequences += full + bool(last)


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    plan = Plan(capacity, counts)
    plan.reduce()
    plan.best_fit()
    return plan


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset`` (gapless from 0 within a sequence).

    Lengths have to be 1 .. capacity.  Rows are staged once in the shared folder, where each
    gets a number, so that ranks hold if an executor is lost.  Empty in, empty out; repeated
    rows are pieces of their own.
    """
    spark = pieces.sparkSession
    buckets = 4 * partitions(spark)
    rows = stage(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    bucket = F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int")
    by_bucket = rows.groupBy(F.col(length).alias("_length"), bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    counts = {r["_length"]: r["n"] for r in by_bucket.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}
    moves = plan_packing(counts, capacity).moves  # a few entries per length: bounded by the capacity
    table = {s: np.array(m, np.int64).T for s, m in moves.items()}
    plan = spark.sparkContext.broadcast(table)
    before = F.sum("_n").over(Window.partitionBy("_length").orderBy("_bucket")) - F.col("_n")
    offsets = by_bucket.withColumn("_before", before).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_length", "_bucket").orderBy("_row"))
    ranked = (rows.withColumn("_length", F.col(length)).withColumn("_bucket", bucket).withColumn("_rank", rank - 1)
              .join(offsets, ["_length", "_bucket"])
              .select(*pieces.columns, F.col("_length"), (F.col("_rank") + F.col("_before")).alias("_rank")))
    schema = T.StructType(pieces.schema.fields + [T.StructField("sequence_id", T.LongType()),
                                                  T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank_ = (b.column(i).to_numpy(zero_copy_only=False) for i in (b.num_columns - 2, b.num_columns - 1))
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                rows_ = np.flatnonzero(size == s)
                start, _, first, at = plan.value[s]
                k = np.searchsorted(start, rank_[rows_], "right") - 1
                sequence[rows_], offset[rows_] = first[k] + rank_[rows_] - start[k], at[k]
            yield pa.RecordBatch.from_arrays(b.columns[:-2] + [pa.array(sequence), pa.array(offset)],
                                             schema.fieldNames())

    return ranked.mapInArrow(place, schema)
