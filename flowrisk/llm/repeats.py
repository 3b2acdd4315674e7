"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

All suffixes are ordered only as deep as the threshold (``width`` bytes), by passes from the
most significant digit on; groups of one drop out after each pass, and the groups that are
left at full depth are exactly the repeated windows.

* The first digit is the least hash of the ``gram``-byte strings in a suffix's window.  Equal
  windows have equal digits, and neighbouring suffixes mostly share theirs, so a run of about
  (width - gram) / 2 suffixes travels as one record.  Its counts come from one row per digit
  and part of the corpus; digits seen once end here, without their text ever being moved.
* Runs that remain travel with their bytes, once per distinct run and part.  Equal runs are
  settled at once: all but the first are repeats.  Distinct runs of one first digit go
  through the remaining passes, eight bytes at a time, on the true bytes.
* A first digit with more than ``hot`` runs (a common line within ever new surroundings) is
  split further: its suffixes go on one by one under a digest of their whole window, so
  that only equal windows meet, at most one per part.

Scale: the corpus is exchanged once, by part, and read three times from that exchange.
Nothing grows with a group of copies but the parts that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.llm.common import free_name, in_pieces, partitions, raw_texts

#: Bytes whose windows are hashed at once, and the bits that hold a place among them.
SEGMENT, PLACE = 1 << 20, np.uint64((1 << 21) - 1)
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2^64."""
    if not _POWERS:
        for k, base in ((0, _ODD), (1, pow(_ODD, -1, 1 << 64))):
            a = np.full(2 * SEGMENT + 1, base, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0], _POWERS[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` consecutive bytes (polynomial, then mixed)."""
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[:len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_least(a: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w consecutive ones, from prefix and suffix minima of blocks."""
    n = len(a) - w + 1
    blocks = np.concatenate([a, np.full(-len(a) % w + w, np.iinfo(a.dtype).max, a.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def runs_of(texts: list[bytes], width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one first digit: text number, first window, windows, digit, twice.

    ``twice``: the digit's string occurs again within a window, so the run may hold a window
    twice.  Long texts are cut into segments that overlap by a window less one byte.
    """
    w = width - gram + 1
    parts = [(i, s) for i, t in enumerate(texts) for s in range(0, len(t) - width + 1, SEGMENT)]
    sizes = [min(SEGMENT + width - 1, len(texts[i]) - s) for i, s in parts]
    for a, b in in_pieces(sizes, SEGMENT):
        cut = [texts[i][s:s + n] for (i, s), n in zip(parts[a:b], sizes[a:b])]
        data = np.frombuffer(b"".join(cut), np.uint8)
        h = gram_hashes(data, gram)
        least = sliding_least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), w)
        place = (least & PLACE).astype(np.int64)
        digit = h[place]
        ends = np.cumsum(sizes[a:b])
        begins = ends - sizes[a:b]
        inside = np.ones(len(digit), bool)
        for e in ends[:-1].tolist():
            inside[e - width + 1:e] = False
        new = np.empty(len(digit), bool)
        new[0] = True
        new[1:] = (digit[1:] != digit[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(digit)))
        real = inside[first]
        first, many = first[real], many[real]
        at = np.searchsorted(begins, first, "right") - 1
        number, shift = (np.array(x, np.int64) for x in zip(*parts[a:b]))
        yield (number[at], first - begins[at] + shift[at], many, digit[first].view(np.int64),
               place[first] != place[first + many - 1])


def first_digits(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct first digits of some texts and their numbers of runs (one more if twice)."""
    found = [(r[3], r[4]) for r in runs_of(texts, width, gram)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    digits, twice = (np.concatenate(x) for x in zip(*found))
    unique, at = np.unique(digits, return_inverse=True)
    return unique, np.bincount(at, minlength=len(unique)) + np.bincount(at[twice], minlength=len(unique))


class Spans:
    """Ranges of rows, merged while they arrive in order."""

    def __init__(self):
        self.rows, self.starts, self.ends = [], [], []

    def add(self, row: int, start: int, end: int) -> None:
        if self.rows and self.rows[-1] == row and start <= self.ends[-1] and start >= self.starts[-1]:
            self.ends[-1] = max(self.ends[-1], end)
        else:
            self.rows.append(row)
            self.starts.append(start)
            self.ends.append(end)


def repeated_windows(contents: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that occur twice or more within their group: (content, offset, class).

    Radix passes of eight bytes from the front; classes of one drop out after each pass.
    """
    sizes = np.array([len(c) for c in contents])
    begin = np.cumsum(sizes) - sizes
    many = sizes - width + 1
    owner = np.repeat(np.arange(len(contents)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    data = np.frombuffer(b"".join(contents) + bytes(8), np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(">u8").ravel().astype(np.uint64)
    digits = list(range(0, width - 7, 8)) + ([width - 8] if width % 8 else [])
    label = group[owner]
    for d in digits:
        word = words[begin[owner] + offset + d]
        order = np.lexsort((word, label))
        label, word = label[order], word[order]
        new = np.ones(len(order), bool)
        new[1:] = (label[1:] != label[:-1]) | (word[1:] != word[:-1])
        label = np.cumsum(new) - 1
        stay = np.bincount(label)[label] > 1
        owner, offset, label = owner[order][stay], offset[order][stay], label[stay]
        if not len(label):
            break
    return owner, offset, label


def settle(table: pa.Table, width: int) -> pa.Table:
    """Ranges to remove, from the runs of some first digits: (part, row, start, end)."""
    part, row, key, start, twice = (table[c].to_numpy() for c in ("part", "row", "key", "start", "twice"))
    group, content = table["digit"].to_numpy(), table["content"].to_pylist()
    out: list[tuple] = []
    best: dict[bytes, int] = {}
    for i in np.lexsort((start, row, key)).tolist():
        c = content[i]
        if c is None:  # settled within its part
            out.append((part[i], row[i], start[i], table["end"][i].as_py()))
        elif c in best:
            out.append((part[i], row[i], start[i], start[i] + len(c)))
        else:
            best[c] = i
    rows = np.array(list(best.values()), np.int64)
    if len(rows):
        unique, at = np.unique(group[rows], return_inverse=True)
        several = (np.bincount(at) > 1)[at] | twice[rows]
        rows, at = rows[several], at[several]
    if len(rows):
        owner, offset, label = repeated_windows([content[i] for i in rows.tolist()], at, width)
        at_row = rows[owner]
        place = start[at_row] + offset
        order = np.lexsort((place, row[at_row], key[at_row], label))
        first = np.ones(len(order), bool)
        first[1:] = label[order][1:] != label[order][:-1]
        again = order[~first]
        again = again[np.lexsort((offset[again], owner[again]))]
        owner, offset = owner[again], offset[again]
        cut = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1))[:len(owner)])
        last = np.append(cut[1:], len(owner)) - 1
        for a, b in zip(cut.tolist(), last.tolist()):
            i = rows[owner[a]]
            out.append((part[i], row[i], start[i] + offset[a], start[i] + offset[b] + width))
    columns = list(zip(*out)) or [()] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "row", "start", "end"), columns,
                                                         (pa.int32(), pa.int64(), pa.int64(), pa.int64()))})


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the spans, and the number of maximal removed ranges."""
    kept, at, n, end = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            n += 1
            kept.append(text[at:a])
        end = at = max(at, b)
    kept.append(text[at:])
    return b"".join(kept), n


def drop_repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 100, gram: int = 24,
                 hot: int = 4096, parts: int | None = None, as_text: bool = False) -> DataFrame:
    """``df`` with ``kept`` (binary) in place of the text, ``n_bytes``, ``n_removed`` and ``n_spans``.

    Removed is every byte within a ``width``-byte string that also starts earlier: in a row
    with a smaller key (a long; null is least; equal keys in row order), or earlier in the
    same text; strings are judged on the input, and overlaps count.  Matches never cross
    texts.  Null and empty texts stay empty, texts shorter than ``width`` stay as they are.
    Other columns pass unchanged; existing columns of the new names are replaced.
    ``as_text`` gives the remaining text (string, in the text's column) instead of ``kept``;
    a character that is cut in two goes as a whole there.  ``width`` is at least 16; ``parts`` are the units of the exchange (four per shuffle
    partition unless given).
    """
    new = ("kept", "n_bytes", "n_removed", "n_spans")
    df = df.drop(*(c for c in new if c != text))
    gram = min(gram, width)
    n = parts or 4 * partitions(df.sparkSession)
    part_, row_ = free_name(df, "_part"), free_name(df, "_row")
    rest = [c for c in df.columns if c != text]
    keyed = df.select(*rest, F.col(text), F.monotonically_increasing_id().alias(row_))
    keyed = keyed.withColumn(part_, F.pmod(F.xxhash64(row_), F.lit(n)).cast("int"))
    by_part = keyed.groupBy(part_)
    least = -(1 << 63)

    def count(table):
        digits, runs = first_digits(raw_texts(table[text].combine_chunks()), width, gram)
        at = table[part_][0].as_py()
        return pa.table({"digit": digits, "part": pa.array([at] * len(digits), pa.int32()), "runs": runs})

    counted = by_part.applyInArrow(count, "digit long, part int, runs long")

    def again(table):
        digit, runs, part = (table[c].to_numpy() for c in ("digit", "runs", "part"))
        unique, at = np.unique(digit, return_inverse=True)
        total = np.bincount(at, runs, len(unique)).astype(np.int64)[at]
        keep = total > 1
        return pa.table({"part": pa.array(part[keep], pa.int32()), "digit": digit[keep], "hot": total[keep] > hot})

    bucket = F.pmod("digit", F.lit(n))
    repeated = counted.groupBy(bucket.alias("bucket")).applyInArrow(
        again, "part int, digit long, hot boolean")

    def candidates(docs, digits):
        at = digits["digit"].to_numpy()
        by = np.argsort(at)
        at, is_hot = at[by], digits["hot"].to_numpy(zero_copy_only=False)[by]
        rows, keys = docs[row_].to_numpy(), docs[key].fill_null(least).cast(pa.int64()).to_numpy()
        order = np.lexsort((rows, keys))
        raw = raw_texts(docs[text].combine_chunks())
        raw, rows, keys = [raw[i] for i in order.tolist()], rows[order], keys[order]
        part = docs[part_][0].as_py() if len(rows) else 0
        seen: set[bytes] = set()
        spans, out = Spans(), []
        for number, start, many, digit, twice in (runs_of(raw, width, gram) if len(at) else ()):
            place = np.minimum(np.searchsorted(at, digit), len(at) - 1)
            pick = np.flatnonzero(at[place] == digit)
            for i, s, m, d, tw, h in zip(number[pick].tolist(), start[pick].tolist(), many[pick].tolist(),
                                         digit[pick].tolist(), twice[pick].tolist(), is_hot[place[pick]].tolist()):
                whole = raw[i][s:s + m + width - 1]
                for a, c in [(j, whole[j:j + width]) for j in range(m)] if h else [(0, whole)]:
                    if c in seen:
                        spans.add(i, s + a, s + a + len(c))
                    else:
                        seen.add(c)
                        if h:
                            d = int.from_bytes(blake2b(c, digest_size=8).digest(), "big", signed=True)
                        out.append((i, s + a, s + a + len(c), d, tw and not h, c))
        out += [(i, s, e, int(rows[i]), False, None) for i, s, e in zip(spans.rows, spans.starts, spans.ends)]
        i, s, e, d, tw, c = list(zip(*out)) or [()] * 6
        i = np.array(i, np.int64)
        return pa.table({"part": pa.array([part] * len(i), pa.int32()), "row": rows[i], "key": keys[i],
                         "start": pa.array(s, pa.int64()), "end": pa.array(e, pa.int64()),
                         "digit": pa.array(d, pa.int64()), "twice": pa.array(tw, pa.bool_()),
                         "content": pa.array(c, pa.binary())})

    runs = by_part.cogroup(repeated.groupBy("part")).applyInArrow(
        candidates,
        "part int, row long, key long, start long, end long, digit long, twice boolean, content binary")
    ranges = runs.groupBy(bucket.alias("bucket")).applyInArrow(
        lambda t: settle(t, width), "part int, row long, start long, end long")
    kept_ = T.StructField(text, T.StringType()) if as_text else T.StructField("kept", T.BinaryType())
    schema = T.StructType([df.schema[c] for c in rest] + [kept_, *(T.StructField(c, T.LongType()) for c in new[1:])])

    def rebuild(docs, found):
        of: dict[int, list[tuple[int, int]]] = {}
        for r, a, b in zip(*(found[c].to_pylist() for c in ("row", "start", "end"))):
            of.setdefault(r, []).append((a, b))
        raw = raw_texts(docs[text].combine_chunks())
        done = [without(t, of.get(r, ())) for t, r in zip(raw, docs[row_].to_pylist())]
        size = [len(t) for t in raw]
        cols = {c: docs[c] for c in rest}
        if as_text:
            cols[text] = pa.array([k.decode("utf-8", "ignore") for k, _ in done], pa.string())
        else:
            cols["kept"] = pa.array([k for k, _ in done], pa.binary())
        cols["n_bytes"] = pa.array(size, pa.int64())
        cols["n_removed"] = pa.array([z - len(k) for z, (k, _) in zip(size, done)], pa.int64())
        cols["n_spans"] = pa.array([m for _, m in done], pa.int64())
        return pa.table(cols)

    return by_part.cogroup(ranges.groupBy("part")).applyInArrow(rebuild, schema)
