"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised straight from the vocabulary.

The model's pieces are the vocabulary's byte strings with each byte mapped to a printable character, scored by negative rank;
normalisation is identity and nothing is added or trimmed. sentencepiece merges the adjacent pair whose piece has the highest
score, leftmost first, which is the rank order of byte-level BPE. Each pre-token is encoded by itself. Decoding maps ids to
pieces and characters back to bytes.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rookery.llm.chunks import BLOCK, ChunkValues, packed
from rookery.llm.common import narrow, runs
from rookery.llm.token_counts import read_ranks


def byte_characters() -> list[str]:
    """A character for each byte: itself where it is visible, else the next of those from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    """One field of a protocol-buffer message: bytes, float or integer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model file: BPE, ids equal to ranks, one unknown piece after them. Ranks must run from 0 without gaps."""
    mapped = byte_characters()
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without gaps")
    parts = [_field(1, _field(1, "".join(mapped[b] for b in p).encode()) + _field(2, float(-r)) + _field(3, 1)) for r, p in enumerate(ordered)]
    parts.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(ordered) + 1) + _field(40, len(ordered))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(parts) + _field(2, trainer) + _field(3, normaliser)


class ByteCodec:
    """encode: list of strings, each of whole pre-tokens -> packed ids; decode: packed ids -> bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.find = regex.compile(pattern).findall
        characters = byte_characters()
        self.to_characters = dict(enumerate(characters))
        back = {c: b for b, c in enumerate(characters)}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.find(t) for t in texts]
        flat = [w.encode().decode("latin-1").translate(self.to_characters) for words in found for w in words]
        ids = iter(self.model.encode(flat, num_threads=1) if flat else [])
        return [b"".join([packed(next(ids)) for _ in words]) for words in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_MADE: dict = {}


def _codec(path: str, pattern: str) -> tuple[ByteCodec, ChunkValues]:
    if (path, pattern) not in _MADE:
        codec = ByteCodec(read_ranks(path), pattern)
        _MADE[path, pattern] = codec, ChunkValues(pattern, codec.encode, b"".join)
    return _MADE[path, pattern]


def _each_text(batches, path: str, pattern: str):
    """(batch, packed ids of each of its texts); a null text is as an empty one."""
    codec, values = _codec(path, pattern)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in runs([len(t) for t in texts], BLOCK):
            yield codec, batch.slice(a, b - a), values.values(texts[a:b])


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> for every row, over whole texts. Null and empty texts give no ids; rows stay as often as they are."""

    def encoded(batches):
        for _, batch, ids in _each_text(batches, ranks_path, pattern):
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(i) // 4 for i in ids)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    rows = narrow(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(encoded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(rows: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of each row's ids (null ids: none), by the inverse mapping."""

    def decoded(batches):
        codec, _ = _codec(ranks_path, pattern)
        for batch in batches:
            made = [codec.decode(packed(ids or [])) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "decoded"])

    rows = narrow(rows, doc_id=id_col, ids=ids_col)
    return rows.mapInArrow(decoded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded, both digested, in one pass without a shuffle."""

    def digested(batches):
        for codec, batch, ids in _each_text(batches, ranks_path, pattern):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(codec.decode(i)).hexdigest() for i in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = narrow(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(digested, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
