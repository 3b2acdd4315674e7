"""Byte-level BPE encoding and decoding through a serialised sentencepiece model.

A rank vocabulary (token bytes -> rank) becomes a sentencepiece BPE model: every byte maps
to one code point, a piece is its token's mapped bytes, its score is the negative rank, and
normalisation is the identity, so that sentencepiece's merges (best score first, leftmost on
ties) are the rank merges.  Texts are cut into pre-tokens by the vocabulary's pattern; each
is encoded by itself, and as a whole where it is a token.  Decoding maps ids back to bytes.

Scale: map-only, no shuffle.  The model (about 1 MB, fixed by the vocabulary) is broadcast;
each Python worker keeps a bounded memo of pre-tokens.
"""

from __future__ import annotations

import base64
import struct

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowrisk.llm.common import map_column, raw_texts, texts

#: Code point of byte 0; bytes follow one another, clear of white space and controls.
FIRST = 0x100
#: Pre-tokens that a worker remembers, and the longest that it does, in characters.
MEMO, MEMO_CHARS = 400_000, 40


def mapped(raw: bytes) -> str:
    return "".join(map(chr, (FIRST + b for b in raw)))


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - FIRST for c in piece)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float, or length-delimited bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece ids equal ranks, the unknown piece comes last."""
    # Fixed values of the sentencepiece model format: field numbers and enumerations.
    # ModelProto: pieces 1, trainer_spec 2, normalizer_spec 3
    # SentencePiece: piece 1, score 2, type 3 (normal 1, unknown 2, unused 5)
    # TrainerSpec: model_type 3 (BPE 2), vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43
    # NormalizerSpec: name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5
    by_rank = {r: t for t, r in ranks.items()}
    size = max(by_rank, default=-1) + 1
    out = []
    for r in range(size):
        token = by_rank.get(r)
        body = (_field(1, f"<unused{r}>".encode()) + _field(2, 0.0) + _field(3, 5) if token is None
                else _field(1, mapped(token).encode()) + _field(2, -float(r)) + _field(3, 1))
        out.append(_field(1, body))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    out.append(_field(2, _field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(41, -1)
                      + _field(42, -1) + _field(43, -1)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Encoder(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; a bounded memo."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.whole = {self.model.id_to_piece(i): i for i in range(self.model.get_piece_size() - 1)
                      if not self.model.is_unused(i)}
        self.table = [b""] * self.model.get_piece_size()
        for piece, i in self.whole.items():
            self.table[i] = unmapped(piece)

    def __missing__(self, token: str) -> bytes:
        piece = mapped(token.encode())
        found = self.whole.get(piece)
        ids = self.model.encode(piece) if found is None else [found]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[token] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.cut(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, memoryview(packed).cast("I")))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(model: bytes, pattern: str) -> Encoder:
    """One encoder per Python worker and model, kept between tasks."""
    key = (len(model), hash(model), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model, pattern)
    return _ENCODERS[key]


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids",
               ) -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit ids) in place of the text.

    Null and empty texts give no ids.  Other columns, clashing or repeated rows included,
    pass unchanged; an existing column named ``ids`` is replaced.
    """
    model = df.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(ranks_path)))
    return map_column(df, text, ids, T.BinaryType(), lambda: encoder(model.value, pattern).encode, texts)


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded",
               ) -> DataFrame:
    """``df`` with the bytes (binary) that the ids stand for in place of the ids."""
    model = df.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(ranks_path)))
    return map_column(df, ids, out, T.BinaryType(), lambda: encoder(model.value, pattern).decode, raw_texts)
