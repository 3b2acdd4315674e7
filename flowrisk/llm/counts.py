"""Token counts with overlap resynchronisation for huge texts.

A text longer than a chunk is encoded in overlapping chunks with offsets.  Two neighbours are
spliced at a position where both have a boundary between pre-tokens and which is stable in
the left chunk: pre-tokens are matched from left to right and none looks behind, so from a
common boundary on the right chunk's tokens are those of the whole text; the left chunk's are
up to there, because the boundary lies farther from its end than any match looks ahead or
any special token reaches.  Where an overlap holds no such position, it is widened (doubled)
and the left chunk encoded again, to the end of the text if need be.

Shorter texts are one chunk.  Of these, only distinct words go through the library: between
a character that is not white space and one that is, every text has a pre-token boundary, so
a text's count is the sum over its (white space, word) pieces, which each worker remembers.

Scale: map-only, no shuffle; memory is bounded by a chunk and the memo.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.llm.common import texts, utf8_size

#: The code points with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
#: A run of white space with the word after it, or the run that ends the text.
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: A pre-token looks at most this many characters beyond its end (contractions).
AHEAD = 3
MEMO, MEMO_CHARS = 400_000, 40


class Counter(dict):
    """Piece -> number of tokens, a bounded memo over a tokenizers model."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_str(spec)
        added = self.model.get_added_tokens_decoder()
        self.special = set(added)
        self.margin = max([AHEAD, *(len(t.content) for t in added.values())]) + 1

    def __missing__(self, piece: str) -> int:
        n = len(self.model.encode(piece, add_special_tokens=False))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n

    def boundaries(self, text: str, start: int, end: int) -> dict[int, int]:
        """Of the chunk [start, end): end of each pre-token -> tokens up to there."""
        e = self.model.encode(text[start:end], add_special_tokens=False)
        ids, words, ends, n = e.ids, e.word_ids, e.offsets, len(e)
        return {start + ends[i][1]: i + 1 for i in range(n)
                if i + 1 == n or words[i] != words[i + 1] or ids[i] in self.special or ids[i + 1] in self.special}

    def resynchronised(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of the whole text from overlapping chunks."""
        size, start, total, before = len(text), 0, 0, 0
        end = min(size, chunk + overlap)
        left = self.boundaries(text, start, end)
        while end < size:
            start, wide = start + chunk, overlap
            right_end = min(size, start + chunk + overlap)
            right = self.boundaries(text, start, right_end)
            while True:
                common = next((p for p in left if start < p <= end - self.margin and p in right), None)
                if common is not None or end == size:
                    break
                wide *= 2
                end = min(size, start + wide)
                left = self.boundaries(text, start - chunk, end)
                if end >= right_end:
                    right_end = min(size, end + chunk)
                    right = self.boundaries(text, start, right_end)
            if common is None:
                break
            total += left[common] - before
            left, before, end = right, right[common], right_end
        return total + max(left.values(), default=0) - before

    def count(self, text: str, chunk: int, overlap: int) -> int:
        if len(text) > chunk + overlap:
            return self.resynchronised(text, chunk, overlap)
        return sum(map(self.__getitem__, PIECE.findall(text)))


_COUNTERS: dict[str, Counter] = {}


def counter(spec: str) -> Counter:
    """One counter per Python worker and tokenizer, kept between tasks."""
    if spec not in _COUNTERS:
        _COUNTERS[spec] = Counter(spec)
    return _COUNTERS[spec]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_counts(df: DataFrame, tokenizer_path: str, text: str = "text", *, limit: int = 1024,
                 chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """``df`` without its text, plus ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Counts are those of the byte-level tokenizer file on the whole text without added
    special tokens; special strings in a text count as the library takes them (one token).
    Null and empty texts have none.  Existing columns of these three names are replaced;
    other columns and repeated rows pass unchanged.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    new = ("n_bytes", "n_tokens", "over_limit")
    rest = [c for c in df.columns if c not in (text, *new)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("n_bytes", T.LongType()),
                                                          T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(spec.value)
        for b in batches:
            n = [c.count(t, chunk, overlap) for t in texts(b.column(len(rest) + 1))]
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.array(n, pa.int64())], [*rest, *new[:2]])

    counted = df.select(*rest, utf8_size(text).alias("n_bytes"), F.col(text)).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
