"""Sharding, encoding, counts and packing against brute force and the libraries."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowrisk.llm import bpe, counts, packing, sharding
from flowrisk.llm.common import utf8_size
from flowrisk.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.conftest import prose


def _documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# sharding

def test_op1_shards(spark):
    texts = _documents(spark)
    rows = QUERIES["op1_histogram_sort"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    size, slots = Counter(), {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(size) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ideal, largest = sum(size.values()) / 24, max(r["size"] for r in rows)
    assert all(abs(size[i] - ideal) <= 0.11 * ideal + largest for i in range(24))


def test_shards_split_only_hot_groups(spark):
    rows = [(i, "same text" if i % 3 else prose(i, 8)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.histogram_shards(df, 10, group=F.col("text"), tie="doc_id", weight=F.lit(1)).collect()
    count = Counter(r["shard"] for r in out)
    assert max(count.values()) - min(count.values()) <= 30
    homes = {}
    for r in out:
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert len(homes.pop("same text")) >= 6
    assert all(len(h) == 1 for h in homes.values())


def test_shards_of_odd_rows(odd_docs, no_docs):
    out = sharding.histogram_shards(odd_docs, 4, group=F.col("text"), tie="doc_id", weight=utf8_size("text") + 8)
    assert out.columns == [*(c for c in odd_docs.columns if c != "shard"), "weight", "shard", "slot"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    for s in range(4):
        places = [r["slot"] for r in rows if r["shard"] == s]
        assert sorted(places) == list(range(len(places)))
    assert sharding.histogram_shards(no_docs, 4, group=F.col("text"), tie="doc_id", weight=F.lit(1)).collect() == []


# byte-level BPE

@pytest.fixture(scope="module")
def reference():
    import tiktoken
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op7_matches_the_library(spark, reference):
    texts = _documents(spark)
    rows = QUERIES["op7_byte_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]] or ""
        ids = reference.encode_ordinary(raw)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(raw.encode()).hexdigest()


def test_bpe_round_trip_of_odd_rows(odd_docs, no_docs, reference):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.bpe_encode(odd_docs.withColumn("source_text", F.col("text")), path, public_tokenizers.PATTERN)
    for r in bpe.bpe_decode(coded, path, public_tokenizers.PATTERN).collect():
        assert bytes(r["decoded"]).decode() == (r["source_text"] or "")
    for r in coded.collect():
        ids = list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"]))
        assert ids == reference.encode_ordinary(r["source_text"] or "")
    assert bpe.bpe_encode(no_docs, path, public_tokenizers.PATTERN).collect() == []


# token counts

@pytest.fixture(scope="module")
def counter():
    return counts.counter(counts.read_spec(public_tokenizers.path("byte_bpe_50k.json")))


def test_op8_matches_the_library(spark, counter):
    texts = _documents(spark)
    for r in QUERIES["op8_token_counts"](spark, SMALL).collect():
        n = len(counter.model.encode(texts[r["doc_id"]] or "", add_special_tokens=False))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 1024)
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())


@pytest.mark.parametrize("chunk,overlap", [(30, 18), (57, 25), (200, 40)])
def test_resynchronised_counts(counter, chunk, overlap):
    r = random.Random(chunk)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'", "'ll", " the", "é", "12", "\x1c", "\x85", "　", "<|endoftext|>", "_" * 50]
    for _ in range(150):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 400)))
        assert counter.count(text, chunk, overlap) == len(counter.model.encode(text, add_special_tokens=False))


def test_overlaps_widen_to_the_end(counter):
    text = "a" * 5_000 + " b"
    assert counter.resynchronised(text, 100, 20) == len(counter.model.encode(text, add_special_tokens=False))


def test_counts_of_odd_rows(odd_docs, no_docs, counter):
    path = public_tokenizers.path("byte_bpe_50k.json")
    kept = odd_docs.withColumn("source_text", F.col("text"))
    for r in counts.token_counts(kept, path, chunk=1000, overlap=100).collect():
        assert r["n_tokens"] == len(counter.model.encode(r["source_text"] or "", add_special_tokens=False))
    assert counts.token_counts(no_docs, path).collect() == []


# packing

def _check_packing(rows, capacity):
    """Pieces fill their sequences without gaps; returns the number of sequences."""
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_op10_packs_all_documents(spark):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = _documents(spark)
    rows = QUERIES["op10_best_fit_packing"](spark, SMALL).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(texts)
    for key, own in pieces.items():
        ids = model.encode(texts[key] or "", add_special_tokens=False).ids + [0]
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 2048)))
        for r in own:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["start"] == 2048 * r["piece"] and len(part) == min(2048, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    used = _check_packing(rows, 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_word_ids_match_the_library():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    model, words, r = Tokenizer.from_file(path), packing.word_ids(packing.read_spec(path)), random.Random(11)
    letters = [chr(c) for c in range(0x41, 0x260) if chr(c).isalpha()] + ["\u0958", "\u0301", "\u1e9e", "\u212b"]
    texts = [x + end for x in letters for end in ("", ".", ",", "..", "a.", "'s.")]
    texts += ["".join(r.choice([*letters, " ", ".", ",", "'s", "1", "\u3000", "<|endoftext|>"]) for _ in range(r.randint(1, 40)))
              for _ in range(2000)]
    for text in texts:
        ids = model.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text


def _least_bins(sizes, capacity):
    """The least number of bins, by trying every bin for the next piece (small cases)."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                left = list(rooms)
                left.remove(room)
                place(i + 1, [*left, room - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])
    place(0, [])
    return best[0]


def test_fixed_sets_keep_an_optimum():
    for seed in range(150):
        r = random.Random(seed)
        sizes = [r.randint(2, 20) for _ in range(r.randint(1, 9))]
        plan = packing.Plan(20, Counter(sizes))
        plan.reduce()
        rest = [s for s, n in plan.left.items() for _ in range(n)]
        assert plan.sequences + (_least_bins(rest, 20) if rest else 0) == _least_bins(sizes, 20)


def test_packing_plan_places_every_piece_once():
    for seed in range(40):
        r = random.Random(seed)
        capacity = r.choice([10, 50, 2048])
        many = Counter(r.randint(1, capacity) for _ in range(r.choice([1, 20, 2000])))
        plan, rows = packing.plan_packing(many, capacity), []
        for size, moves in plan.moves.items():
            end = 0
            for start, n, first, offset in sorted(moves):
                assert start == end
                end += n
                rows += [{"sequence_id": first + k, "offset": offset, "length": size} for k in range(n)]
            assert end == many[size]
        assert _check_packing(rows, capacity) == plan.sequences


def test_packing_of_odd_rows(odd_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.token_pieces(odd_docs, path, 64, keep_ids=True)
    rows = packing.pack(pieces, 64).collect()
    assert len(rows) == pieces.count() and len({r["doc_id"] for r in rows}) == len({r["doc_id"] for r in odd_docs.collect()})
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    _check_packing(rows, 64)
    assert packing.pack(packing.token_pieces(no_docs, path, 64), 64).collect() == []
