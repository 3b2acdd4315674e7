"""Line deduplication by a log-template tree.

Lines are parsed to a fixed depth: by their number of tokens, then by their leading tokens,
where a token with a digit counts as a variable field.  Within a leaf, lines whose tokens
agree closely enough are one template, and the fields in which they differ become variable.
Templates that recur in many documents are dropped (their first line stays, unless told).

Stages: one narrow row per line (leaf and line hashes) is staged; leaves that occur in too
few documents end there.  Only leaves with several different lines need those lines' text,
one copy of each.  Scale: documents are counted by partial aggregation, so a line in every
third document is one row per task.  The depth is the same at every size: a leaf with many
different lines is split into groups that share no template, which gives the same templates;
a group's lines stream through one task, which holds the templates and not the lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.llm.common import free_name, in_pieces, partitions, texts
from flowrisk.llm.components import components
from flowrisk.session import stage

DIGIT = re.compile("[0-9]").search
DIGITS = re.compile("[0-9]+")
FIELD = "<*>"
#: Lines that a broadcast may name; beyond it the texts are joined by a shuffle.
BROADCAST_LINES = 200_000
#: Keys that a line of a large leaf may be given.
MOST_SHARES = 24


def masked(line: str) -> list[str]:
    """Tokens of a line; those with a digit are variable fields."""
    tokens = line.split()
    return [FIELD if DIGIT(t) else t for t in tokens] if DIGIT(line) else tokens


def _hash(text: str) -> int:
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(text) - (1 << 63)


def masked_short(line: str) -> list[str]:
    """Tokens of a line too short for the tree, which is a template as it stands.

    Tokens with a digit are fields as long as a word stays beside them; else, and in tokens
    that are not ASCII (scripts without spaces have whole sentences there), only the digits are.
    """
    tokens = line.split()
    word = not all(map(DIGIT, tokens))
    return [FIELD if word and t.isascii() and DIGIT(t) else DIGITS.sub(FIELD, t) for t in tokens]


def _lines(text: str, depth: int, least: int, short: bool) -> Iterator[tuple[int, int, int]]:
    """Line number, leaf and line hash of the lines that can be templates."""
    for no, line in enumerate(text.split("\n")):
        tokens = masked(line)
        if len(tokens) >= least:
            yield no, _hash(f"{len(tokens)} " + " ".join(tokens[:depth])), _hash(" ".join(tokens))
        elif short and tokens:  # a leaf of its own
            own = _hash("\n" + " ".join(masked_short(line)))
            yield no, own, own


def allowed(n: int, alike: float) -> int:
    """Most fields in which a line of ``n`` tokens may differ from the first line of its template."""
    return next((n - s for s in range(n + 1) if s >= alike * n), 0)


def bands(n: int, depth: int, alike: float) -> list[tuple[int, ...]]:
    """Places past the leading ``depth``, cut into one band more than fields may differ."""
    parts, places = allowed(n, alike) + 1, range(min(depth, n), n)
    return [tuple(places[k * len(places) // parts:(k + 1) * len(places) // parts]) for k in range(parts)]


@lru_cache(maxsize=1024)
def shares(n: int, depth: int, alike: float) -> list[tuple[int, ...]]:
    """Sets of places: lines of one leaf that can meet in a template agree in all of one set.

    All ways to leave out the fields that may differ where these are few, else ``bands``.
    """
    left = n - min(depth, n)
    take = max(0, left - allowed(n, alike))
    if comb(left, take) <= MOST_SHARES:
        return list(combinations(range(n - left, n), take))
    return bands(n, depth, alike)


class Templates:
    """The templates of one leaf, which its lines (of one token count) meet one after the other.

    A line joins the template with most equal fields if these are at least ``alike`` of all
    (the earlier one on ties); fields that differ become variable and equal nothing.  With
    ``masks`` a field with digits agrees with one at its place, as a token of its own; without,
    such fields equal nothing either.  As a template only loses fields, its first line has all that a later one can agree with: only
    templates whose first line shares a band are compared once there are many.
    """

    def __init__(self, n: int, alike: float, depth: int = 0, masks: bool = False):
        self.nothing = None if masks else FIELD
        self.least, self.bands = alike * n, bands(n, depth, alike)
        self.ids: dict[str, int] = {}
        self.known = np.empty((16, n), np.int64)
        self.first: list[int] = []
        self.by_band: dict[tuple, list[int]] = {}

    def place(self, line: list[str], name: int) -> int:
        """The name of the first line of the template that ``line`` joins (its own if it starts one)."""
        own = np.array([-2 if t == self.nothing else self.ids.get(t, -2) for t in line], np.int64)
        shared = [(k, *(line[i] for i in band)) for k, band in enumerate(self.bands)]
        size = len(self.first)
        if size <= 256:
            near = np.arange(size)
        else:
            near = np.array(sorted(set().union(*(self.by_band.get(s, ()) for s in shared))), np.int64)
        if len(near):
            same = self.known[near] == own
            score = same.sum(axis=1)
            best = int(score.argmax())
            if score[best] >= self.least:
                self.known[near[best]][~same[best]] = -1
                return self.first[near[best]]
        if size == len(self.known):
            self.known = np.concatenate([self.known, np.empty_like(self.known)])
        self.known[size] = [-1 if t == self.nothing else self.ids.setdefault(t, len(self.ids)) for t in line]
        for s in shared:
            self.by_band.setdefault(s, []).append(size)
        self.first.append(name)
        return name


def parse(lines: list[list[str]], alike: float, masks: bool = False) -> list[int]:
    """Template of each line of one leaf (same token count), as the number of its first line."""
    found = Templates(len(lines[0]) if lines else 0, alike, masks=masks)
    return [found.place(line, i) for i, line in enumerate(lines)]


def _groups(word: DataFrame, depth: int, alike: float) -> DataFrame:
    """``(node, component)`` of the lines that links of possible agreement hold together."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, tokens = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in in_pieces([len(t) for t in tokens], 1 << 16):
                line, share = [], []
                for a, t in zip(lines[i:j], tokens[i:j]):
                    head = f"{len(t)} " + " ".join(t[:depth])
                    for k, at in enumerate(shares(len(t), depth, alike)):
                        line.append(a)
                        share.append(_hash(f"{k} {head} " + " ".join(t[p] for p in at)))
                yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(share, pa.int64())], ["a", "share"])

    share = stage(word.select("line", "tokens").mapInArrow(cut, "a long, share long"), "shares")
    least = share.groupBy("share").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    return components(share.join(least.select("share", "b"), "share").select("a", "b"))


def drop_templates(df: DataFrame, *, key: str = "doc_id", text: str = "text", depth: int = 3, least_tokens: int = 6,
                   alike: float = 0.8, min_documents: int = 10, keep_first: bool = True, leaf_lines: int = 8192,
                   short_lines: bool = False) -> DataFrame:
    """``df`` with the recurring lines taken from its text, plus ``n_lines`` and ``n_dropped``.

    Lines are split at line feeds.  Those with fewer than ``least_tokens`` tokens stay out of
    the tree; with ``short_lines`` each is a template as it stands, but for its digits (see
    ``masked_short``), and only blank lines are none.  A template recurs if ``min_documents`` documents have it; with ``keep_first``
    its first line (least key, then line number) stays.  Null texts stay null, texts without
    a recurring line stay as they are.  Rows with the same key and text count as one document
    and lose the same lines.  A leaf with more than ``leaf_lines`` different lines is split without
    a change of its templates.  Existing columns of the new names are replaced.
    """
    spark = df.sparkSession
    df = df.drop("n_lines", "n_dropped")
    h = free_name(df, "_h")
    docs = df.withColumn(h, F.xxhash64(text))
    ids = docs.select(F.col(key).cast("long").alias("key"), F.col(h).alias("h"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = texts(b.column(2))
            for i, j in in_pieces([len(v) for v in values], 4 << 20):
                row, no, leaf, line, new = [], [], [], [], []
                for r in range(i, j):
                    seen = set()
                    for n, a, c in _lines(values[r], depth, least_tokens, short_lines):
                        row.append(r)
                        no.append(n)
                        leaf.append(a)
                        line.append(c)
                        new.append(a not in seen)
                        seen.add(a)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int32()), pa.array(leaf, pa.int64()),
                     pa.array(line, pa.int64()), pa.array(new, pa.bool_())], ["key", "h", "no", "leaf", "line", "new"])

    lines = stage(ids.mapInArrow(cut, "key long, h long, no int, leaf long, line long, new boolean"), "lines")
    common = stage(lines.groupBy("leaf").agg(F.sum(F.col("new").cast("int")).alias("n"))
                   .where(F.col("n") >= min_documents).select("leaf"), "common-leaves")
    lines = stage(lines.join(common, "leaf", "left_semi").drop("new"), "common-lines")
    first = F.struct("key", "h", "no")
    different = stage(lines.groupBy("leaf", "line").agg(F.min(first).alias("at")), "distinct")
    many = different.groupBy("leaf").agg(F.count("*").alias("lines"))
    shared = different.join(many.where("lines > 1"), "leaf")
    wanted = stage(shared.select("leaf", "line", "at.key", "at.h", "at.no").groupBy("key", "h")
                   .agg(F.collect_list(F.struct("leaf", "line", "no")).alias("want")), "wanted")
    if (wanted.agg(F.sum(F.size("want"))).first()[0] or 0) <= BROADCAST_LINES:  # about 40 bytes each
        wanted = F.broadcast(wanted)
    same = ids["key"].eqNullSafe(wanted["key"]) & (ids["h"] == wanted["h"])
    fetched = ids.join(wanted, same).select("text", "want")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, want in zip(texts(b.column(0)), b.column(1).to_pylist()):
                split = t.split("\n")
                rows += [(w["leaf"], w["line"], masked(split[w["no"]])) for w in want]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string())))],
                ["leaf", "line", "tokens"])

    word = stage(fetched.mapInArrow(fetch, "leaf long, line long, tokens array<string>")
                 .dropDuplicates(["leaf", "line"]), "tokens")
    large = many.where(F.col("lines") > leaf_lines).select("leaf")
    if large.isEmpty():
        word = word.withColumn("node", F.col("leaf"))
    else:  # lines that no chain of possible agreement links never meet in a template
        apart = stage(word.join(large, "leaf", "left_semi"), "large-leaves")
        group = _groups(apart, depth, alike)
        apart = apart.join(group, F.col("line") == F.col("node"), "left").select(
            "leaf", "line", "tokens", F.coalesce("component", "line").alias("node"))
        word = word.join(large, "leaf", "left_anti").withColumn("node", F.col("leaf")).unionByName(apart)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, found = None, None
        for b in batches:
            out = []
            for a, line, tokens in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
                if a != node:
                    node, found = a, Templates(len(tokens), alike, depth, masks=True)
                out.append(found.place(tokens, line))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.int64())],
                                             ["leaf", "line", "template"])

    word = word.select("node", "leaf", "line", "tokens").repartition(partitions(spark), "node")
    grown = word.sortWithinPartitions("node", "line").mapInArrow(grow, "leaf long, line long, template long")
    alone = different.join(many.where("lines = 1"), "leaf").select("leaf", "line", F.col("line").alias("template"))
    tree = stage(grown.union(alone), "tree")
    placed = lines.join(tree, ["leaf", "line"])
    per_document = placed.groupBy("leaf", "template", "key", "h").agg(F.min("no").alias("no"))
    recurring = (per_document.groupBy("leaf", "template").agg(F.count("*").alias("n"), F.min(first).alias("at"))
                 .where(F.col("n") >= min_documents).select("leaf", "template", "at"))
    gone = placed.join(recurring, ["leaf", "template"])
    if keep_first:
        stays = F.col("key").eqNullSafe(F.col("at.key")) & (F.col("h") == F.col("at.h")) & (F.col("no") == F.col("at.no"))
        gone = gone.where(~stays)
    gone = gone.groupBy(F.col("key").alias("_gone_key"), F.col("h").alias("_gone_h")).agg(F.collect_set("no").alias("_gone"))
    matched = F.col(key).cast("long").eqNullSafe(F.col("_gone_key")) & (F.col(h) == F.col("_gone_h"))
    rest = [c for c in df.columns if c != text]
    joined = docs.join(gone, matched, "left").select(*rest, text, "_gone")
    schema = T.StructType([df.schema[c] for c in df.columns] + [
        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    place = df.columns.index(text)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, dropped = [], [], []
            for t, g in zip(b.column(len(rest)).to_pylist(), b.column(len(rest) + 1).to_pylist()):
                split = [] if t is None else t.split("\n")
                total.append(len(split))
                dropped.append(len(g or ()))
                out = set(g or ())
                kept.append(t if not g else "\n".join(x for i, x in enumerate(split) if i not in out))
            columns = b.columns[:len(rest)]
            columns.insert(place, pa.array(kept, pa.string()))
            yield pa.RecordBatch.from_arrays(columns + [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
                                             schema.fieldNames())

    return joined.mapInArrow(rebuild, schema)
