"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the corpus contracts: space, tab, line feed, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8_size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


#: Characters or bytes that are worked on before their rows are handed back.
AT_ONCE = 4 << 20


class Memo(dict):
    """Results of a function by its (text) argument, bounded: two generations of entries.

    Only arguments that come a second time are kept (by a table of hashes, where two may be
    taken for one, which costs an entry and nothing else): most different words come once.
    When the younger generation is full it becomes the elder, so what is in use stays known.
    Long arguments are not kept.
    """

    MOST, LONGEST, SEEN = 250_000, 40, 1 << 22

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.elder, self.seen = make, {}, bytearray(self.SEEN)

    def __missing__(self, key: str):
        value = self.elder.get(key)
        if value is None:
            value = self.make(key)
            slot = hash(key) & self.SEEN - 1
            if not self.seen[slot]:
                self.seen[slot] = 1
                return value
        if len(key) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.elder, self.seen = dict(self), bytearray(self.SEEN)
                self.clear()
            self[key] = value
        return value


def in_pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to at most ``most`` (or hold one item)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_column(df: DataFrame, source: str, target: str, kind: T.DataType, maker: Callable[[], Callable],
               read: Callable[[pa.Array], list]) -> DataFrame:
    """``df`` with ``target``, a function of each value of ``source``, in place of ``source``.

    ``maker`` builds the function once per task; rows go back in batches of bounded size.
    """
    rest = [c for c in df.columns if c not in (source, target)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(target, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = maker()
        for b in batches:
            values = read(b.column(len(rest)))
            for i, j in in_pieces([len(v) for v in values], AT_ONCE):
                new = pa.array([f(v) for v in values[i:j]], TO_ARROW[type(kind)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(k).slice(i, j - i) for k in range(len(rest))] + [new], [*rest, target])

    return df.select(*rest, F.col(source)).mapInArrow(run, schema)


TO_ARROW = {T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.StringType: pa.string()}
