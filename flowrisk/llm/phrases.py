"""Removal of repeated passages by sharded Aho-Corasick automata over words.

A passage recurs if every window of ``width`` consecutive words in it starts at two or more
places.  All copies of a recurring passage are removed, the first included.

* The anchor of a window is its ``gram``-word string of least hash (the first on ties), so
  equal windows have equal anchors at the same place, and neighbours mostly share theirs: a
  run of about (width - gram) / 2 windows is one record.  Anchors that occur once in the
  corpus hold no recurring window; their stretches are never moved.
* Stretches (the words of a run) with a recurring anchor go to the anchor's shard.  There the
  recurring passages are confirmed, word by word: windows are counted exactly, and each
  stretch gives its maximal ranges of windows found twice or more.
* Each shard compiles one Aho-Corasick automaton of its confirmed passages (keys are
  sequences of word numbers) and streams its stretches of all documents through it.  What it
  finds, at its places in the documents, is removed.
* An anchor with more than ``hot`` different stretches (a common line within ever new
  surroundings) is split: its windows are counted by digest first, and only windows whose
  digest is found twice go on, each to the shard of its own digest.

Scale: documents are exchanged once, by part, and read from that exchange; parts and shards
follow the corpus' bytes, so that neither a part, nor a shard, nor its automaton grows with it.
Equal stretches of one part travel once, with their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.llm.common import free_name, in_pieces, partitions, raw_texts, utf8_size
from flowrisk.llm.repeats import sliding_least

#: Words whose windows are hashed at once, and the bits that hold a place among them.
BLOCK, PLACE = 1 << 20, np.uint64((1 << 21) - 1)
#: Bytes of text in a part, and of documents that are split into words at once.
PART_BYTES, TEXT_BYTES = 8 << 20, 4 << 20
#: Longest word (in bytes) that is hashed eight bytes at a time; longer ones go one by one.
LONG_WORD = 64
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out *= np.uint64(_ODD)
        out += h[i:i + n]
    return _mix(out)


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word ``data[start:end]``; eight bytes follow the last word."""
    size = end - start
    at_eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    out = size.astype(np.uint64)
    pick = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(pick):
        own = at_eight[start[pick] + done] & _BYTES[np.minimum(size[pick] - done, 8)]
        out[pick] = _mix((out[pick] ^ own) * np.uint64(_ODD))
        done += 8
        pick = pick[size[pick] > done]
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        from xxhash import xxh3_64_intdigest
        out[long] = [xxh3_64_intdigest(data[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())]
    return out


class Block:
    """Some documents' words as hashes, and the windows that lie within one document."""

    def __init__(self, first: int, raws: list[bytes], width: int):
        self.first, self.width = first, width
        self.data = b" ".join(raws) + bytes([32] * 9)
        space = _SPACE[np.frombuffer(self.data, np.uint8)]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = edge if space[0] else np.append(0, edge)
        self.start, self.end = edge[::2], edge[1::2]
        self.hashes = word_hashes(self.data, self.start, self.end)
        ahead = np.cumsum([0] + [len(r) + 1 for r in raws])
        self.begins = np.searchsorted(self.start, ahead[:-1])
        self.ends = np.searchsorted(self.start, ahead[1:])

    def inside(self) -> np.ndarray:
        """Whether the window that starts at each word lies within its document."""
        ok = np.ones(max(0, len(self.hashes) - self.width + 1), bool)
        for e in self.ends[:-1].tolist():
            ok[max(0, e - self.width + 1):e] = False
        return ok

    def runs(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and anchor digit of each run."""
        ok = self.inside()
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        if ok.any():
            h = rolling(self.hashes, gram)
            for at in range(0, len(ok), BLOCK):  # equal windows have equal anchors wherever the cuts are
                own, reach = ok[at:at + BLOCK], self.width - gram + 1
                some = h[at:at + len(own) + reach - 1]
                least = sliding_least((some & ~PLACE) | np.arange(len(some), dtype=np.uint64), reach)
                place = (least & PLACE).astype(np.int64)
                new = np.ones(len(own), bool)
                new[1:] = (place[1:] != place[:-1]) | (own[1:] != own[:-1])
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(own)))
                real = own[first]
                out.append((first[real] + at, many[real], some[place[first[real]]].view(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def stretch_hashes(self, first: np.ndarray, many: np.ndarray) -> np.ndarray:
        """A hash of the words of each run."""
        n = len(self.hashes)
        up, down = np.full(n + 1, _ODD, np.uint64), np.full(n + 1, pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * up[:n], dtype=np.uint64)])
        return _mix((sums[first + many + self.width - 1] - sums[first]) * down[first])

    def places(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document (by its number in the part) and word of each window."""
        at = np.searchsorted(self.ends, first, "right")
        return self.first + at, first - self.begins[at]

    def texts(self, first: np.ndarray, many: np.ndarray) -> list[bytes]:
        """The words of each run, joined by single spaces."""
        last = first + many + self.width - 2
        return [b" ".join(self.data[a:b].split()) for a, b in zip(self.start[first].tolist(), self.end[last].tolist())]


def blocks(raws: list[bytes], width: int) -> Iterator[Block]:
    """The documents in blocks of bounded size; a longer document is a block of its own."""
    for i, j in in_pieces([len(r) for r in raws], TEXT_BYTES):
        yield Block(i, raws[i:j], width)


def _found(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values


def window_labels(ids: np.ndarray, width: int) -> np.ndarray:
    """Equal numbers for equal sequences of ``width`` ids, by doubling."""
    have = 1
    _, label = np.unique(ids, return_inverse=True)
    while have < width:
        step = min(have, width - have)
        pair = label[:-step] * (int(label.max()) + 1) + label[step:]
        _, label = np.unique(pair, return_inverse=True)
        have += step
    return label


def confirmed(contents: list[bytes], digits: np.ndarray, copies: np.ndarray,
              width: int) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """The contents as word numbers, and the passages all of whose windows occur twice or more.

    Windows of contents with different digits differ, so the only content of a digit recurs as
    a whole or not at all; windows of the others are counted.
    """
    number: dict[bytes, int] = {}
    coded = [tuple([number.setdefault(w, len(number)) for w in c.split()]) for c in contents]
    _, at, several = np.unique(digits, return_inverse=True, return_counts=True)
    several = several[at] > 1
    passages = {coded[i] for i in np.flatnonzero(~several & (copies > 1)).tolist()}
    pick = np.flatnonzero(several)
    if len(pick):
        some = [coded[i] for i in pick.tolist()]
        sizes = np.array([len(c) for c in some])
        ids = np.fromiter((x for c in some for x in c), np.int64, int(sizes.sum()))
        label = window_labels(ids, width)
        begin = np.cumsum(sizes) - sizes
        many = sizes - width + 1
        owner = np.repeat(np.arange(len(some)), many)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        label = label[begin[owner] + offset]
        again = np.bincount(label, copies[pick][owner])[label] > 1
        owner, offset = owner[again], offset[again]
        cut = np.ones(len(owner), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
        head = np.flatnonzero(cut)
        tail = np.append(head[1:], len(owner))[:len(head)] - 1
        passages |= {some[o][a:b + width] for o, a, b in zip(owner[head].tolist(), offset[head].tolist(), offset[tail].tolist())}
    return coded, list(passages)


def automaton(passages: list[tuple[int, ...]]):
    """An Aho-Corasick automaton whose keys are sequences of word numbers, values their lengths."""
    from ahocorasick import KEY_SEQUENCE, STORE_INTS, Automaton
    out = Automaton(STORE_INTS, KEY_SEQUENCE)
    for p in passages:
        out.add_word(p, len(p))
    out.make_automaton()
    return out


def occurrences(machine, words: tuple[int, ...]) -> list[tuple[int, int]]:
    """Merged ranges of words that the automaton's passages cover."""
    spans: list[tuple[int, int]] = []
    for last, n in machine.iter(words):
        a, b = last - n + 1, last + 1
        while spans and a <= spans[-1][1]:
            a = min(a, spans.pop()[0])
        spans.append((a, b))
    return spans


def locate(table: pa.Table, width: int) -> pa.Table:
    """Where the recurring passages of one shard stand: (part, row, start, end) in words."""
    of: dict[bytes, list[int]] = {}
    for i, c in enumerate(table["content"].to_pylist()):
        of.setdefault(c, []).append(i)
    digits = table["digit"].to_numpy()[[own[0] for own in of.values()]]
    places = [np.frombuffer(p, np.int64).reshape(-1, 2) for p in table["places"].to_pylist()]
    copies = np.array([sum(len(places[i]) for i in own) for own in of.values()], np.float64)
    coded, passages = confirmed(list(of), digits, copies, width)
    part = table["part"].to_numpy()
    out: list[np.ndarray] = []
    if passages:
        machine = automaton(passages)
        for words, own in zip(coded, of.values()):
            for a, b in occurrences(machine, words):
                for i in own:
                    row, start = places[i].T
                    out.append(np.stack([np.full(len(row), part[i], np.int64), row, start + a, start + b], axis=1))
    found = np.concatenate(out) if out else np.empty((0, 4), np.int64)
    return pa.table({"part": pa.array(found[:, 0].astype(np.int32)), "row": found[:, 1].copy(),
                     "start": found[:, 2].copy(), "end": found[:, 3].copy()})


def drop_phrases(df: DataFrame, *, text: str = "text", width: int = 35, gram: int = 8, hot: int = 4096,
                 parts: int | None = None) -> DataFrame:
    """``df`` with ``kept`` (string) in place of the text, ``n_words`` and ``n_removed`` (longs).

    Words are what ASCII white space parts.  Removed is every word within a window of
    ``width`` words whose sequence also starts anywhere else, in any row or earlier or later in
    the same text; windows are judged on the input and never cross texts.  ``kept`` is the
    remaining words joined by single spaces (so also for texts that lose none).  Repeated rows
    are copies of each other and lose such windows too.  Null, empty and blank texts have no
    words and keep an empty text; texts under ``width`` words lose none; empty in, empty out.
    Other columns pass unchanged; existing columns of the new names are replaced.  ``gram`` is
    at most ``width``; ``parts`` are the units of the exchange (from the bytes unless given).
    """
    new = ("kept", "n_words", "n_removed")
    df = df.drop(*(c for c in new if c != text))
    gram = min(gram, width)
    spark = df.sparkSession
    if parts is None:
        total = df.agg(F.sum(utf8_size(text))).first()[0] or 0
        parts = max(2 * partitions(spark), -(-total // PART_BYTES))
    n = int(parts)
    part_, row_ = free_name(df, "_part"), free_name(df, "_row")
    rest = [c for c in df.columns if c != text]
    keyed = df.select(*rest, F.col(text), F.monotonically_increasing_id().alias(row_))
    keyed = keyed.withColumn(part_, F.pmod(F.xxhash64(row_), F.lit(n)).cast("int"))
    by_part = keyed.groupBy(part_)

    def read(docs):
        return blocks(raw_texts(docs[text].combine_chunks()), width)

    def count(docs):
        digits, kinds = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for b in read(docs):
            first, many, digit = b.runs(gram)
            digits.append(digit)
            kinds.append(b.stretch_hashes(first, many))
        digit, kind = np.concatenate(digits), np.concatenate(kinds)
        order = np.lexsort((kind, digit))
        digit, kind = digit[order], kind[order]
        new_digit = np.ones(len(digit), bool)
        new_digit[1:] = digit[1:] != digit[:-1]
        new_kind = new_digit.copy()
        new_kind[1:] |= kind[1:] != kind[:-1]
        head = np.flatnonzero(new_digit)
        runs = np.diff(np.append(head, len(digit)))
        different = np.add.reduceat(new_kind.astype(np.int64), head) if len(head) else head
        return pa.table({"digit": digit[head], "part": pa.array([docs[part_][0].as_py()] * len(head), pa.int32()),
                         "runs": runs, "kinds": different})

    def again(table):
        digit, part, runs, kinds = (table[c].to_numpy() for c in ("digit", "part", "runs", "kinds"))
        unique, at = np.unique(digit, return_inverse=True)
        stay = np.bincount(at, runs, len(unique))[at] > 1
        many = np.bincount(at, kinds, len(unique))[at] > hot
        return pa.table({"part": pa.array(part[stay], pa.int32()), "digit": digit[stay], "hot": many[stay]})

    bucket = F.pmod("digit", F.lit(n)).alias("bucket")
    seen_twice = "part int, digit long, hot boolean"
    counted = by_part.applyInArrow(count, "digit long, part int, runs long, kinds long")
    repeated = counted.groupBy(bucket).applyInArrow(again, seen_twice)

    def hot_windows(docs, digits):
        at = np.sort(digits["digit"].to_numpy())
        found = [np.empty(0, np.int64)]
        for b in read(docs) if len(at) and len(docs) else ():
            first, many, digit = b.runs(gram)
            pick = _found(at, digit)
            first, many = first[pick], many[pick]
            windows = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            found.append(rolling(b.hashes, width)[windows].view(np.int64))
        digest, runs = np.unique(np.concatenate(found), return_counts=True)
        part = docs[part_][0].as_py() if len(docs) else 0
        return pa.table({"digit": digest, "part": pa.array([part] * len(digest), pa.int32()), "runs": runs,
                         "kinds": np.full(len(digest), hot + 1)})

    split = by_part.cogroup(repeated.where("hot").groupBy("part")).applyInArrow(
        hot_windows, "digit long, part int, runs long, kinds long")
    wanted = repeated.where("not hot").union(split.groupBy(bucket).applyInArrow(again, seen_twice))

    def stretches(docs, digits):
        alone = digits["hot"].to_numpy(zero_copy_only=False)
        all_ = digits["digit"].to_numpy()
        anchors, windows = np.sort(all_[~alone]), np.sort(all_[alone])
        rows = docs[row_].to_numpy()
        out: dict[tuple[int, bytes], list[int]] = {}
        for b in read(docs) if len(all_) and len(docs) else ():
            first, many, digit = b.runs(gram)
            pick = _found(anchors, digit)
            first, many, digit = first[pick], many[pick], digit[pick]
            if len(windows):
                digest = rolling(b.hashes, width).view(np.int64)
                single = np.flatnonzero(_found(windows, digest) & b.inside())
                first = np.concatenate([first, single])
                many = np.concatenate([many, np.ones(len(single), np.int64)])
                digit = np.concatenate([digit, digest[single]])
            doc, start = b.places(first)
            for d, s, key, c in zip(rows[doc].tolist(), start.tolist(), digit.tolist(), b.texts(first, many)):
                out.setdefault((key, c), []).extend((d, s))
        part = docs[part_][0].as_py() if len(docs) else 0
        return pa.table({"digit": pa.array([k for k, _ in out], pa.int64()),
                         "content": pa.array([c for _, c in out], pa.binary()),
                         "part": pa.array([part] * len(out), pa.int32()),
                         "places": pa.array([np.array(p, np.int64).tobytes() for p in out.values()], pa.binary())})

    moved = by_part.cogroup(wanted.groupBy("part")).applyInArrow(
        stretches, "digit long, content binary, part int, places binary")
    ranges = moved.groupBy(bucket).applyInArrow(lambda t: locate(t, width), "part int, row long, start long, end long")
    schema = T.StructType([df.schema[c] for c in rest] + [
        T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def rebuild(docs, found):
        of: dict[int, list[tuple[int, int]]] = {}
        for r, a, b in zip(*(found[c].to_pylist() for c in ("row", "start", "end"))):
            of.setdefault(r, []).append((a, b))
        kept, total, removed = [], [], []
        for raw, r in zip(raw_texts(docs[text].combine_chunks()), docs[row_].to_pylist()):
            words = raw.split()
            left, at = [], 0
            for a, b in sorted(of.get(r, ())):
                left += words[at:a]
                at = max(at, b)
            left += words[at:]
            kept.append(b" ".join(left).decode())
            total.append(len(words))
            removed.append(len(words) - len(left))
        cols = {c: docs[c] for c in rest}
        return pa.table(cols | {"kept": pa.array(kept, pa.string()), "n_words": pa.array(total, pa.int64()),
                                "n_removed": pa.array(removed, pa.int64())})

    return by_part.cogroup(ranges.groupBy("part")).applyInArrow(rebuild, schema)
