"""Byte-level BPE through a sentencepiece model that is serialised straight from the rank file.

Every byte is mapped to one printable character, every token of the vocabulary becomes a
piece of such characters with score minus its rank, and normalisation is the identity;
sentencepiece's merge order is then the rank order. Pre-tokens are encoded one by one
and ids decode by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .units import UnitCache, in_blocks

OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


@lru_cache(1)
def byte_characters() -> str:
    """256 characters, one for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in shown else chr(next(spare)) for b in range(256))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    """A protocol-buffer field: int as varint, float as 32 bits, bytes and str by length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is <unk>, piece rank + 1 the token of that rank.

    Ranks must be 0 to n - 1 without gaps, and each single byte a token.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks have gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing}")
    # Numbers of the public sentencepiece_model.proto: ModelProto 1 pieces, 2 trainer_spec, 3 normalizer_spec;
    # piece 1 text, 2 score, 3 type (1 normal, 2 unknown); trainer 3 model_type (2 BPE), 4 vocab_size;
    # normalizer 1 name, 3 add_dummy_prefix, 4 remove_extra_whitespaces, 5 escape_whitespaces.
    letters = byte_characters()
    out = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, token in enumerate(tokens):
        out.append(_field(1, _field(1, "".join(map(letters.__getitem__, token))) + _field(2, float(-rank)) + _field(3, 1)))
    out.append(_field(2, _field(3, 2) + _field(4, len(tokens) + 1)))
    out.append(_field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encodes and decodes as a rank-file tokenizer with ``pattern`` would, without special tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = load_ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.units = UnitCache(self._encode_units, lambda a, b: (f"{a[0]},{b[0]}", a[1] + b[1], a[2] + b[2]), 80_000)

    def encode_pretokens(self, found: list[str]) -> list[tuple[int, ...]]:
        """A pre-token that is a token is that token; sentencepiece merges the others.

        Many pre-tokens share a call, set apart by a character that no piece holds.
        """
        ids = [(r,) if (r := self.ranks.get(w.encode("utf-8", "surrogatepass"))) is not None else None for w in found]
        others = [k for k, x in enumerate(ids) if x is None]
        for start in range(0, len(others), 500):
            some = others[start : start + 500]
            letters = [found[k].encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for k in some]
            merged = np.array(self.model.encode("\n".join(letters), num_threads=1), np.int64) - 1
            cuts = np.flatnonzero(merged < 0).tolist()
            flat = merged.tolist()
            for k, a, b in zip(some, [0, *(c + 1 for c in cuts)], [*cuts, len(flat)], strict=True):
                ids[k] = tuple(flat[a:b])
        return ids

    def _encode_units(self, units: list[str]) -> list[tuple[str, int, bytes]]:
        """Of each unit the ids in decimal, their number, and the bytes that they decode to."""
        cut = [self.split(u) for u in units]
        distinct = list({w for words in cut for w in words})
        ids_of = dict(zip(distinct, self.encode_pretokens(distinct), strict=True))
        out = []
        for words in cut:
            ids = [i for w in words for i in ids_of[w]]
            out.append((",".join(map(str, ids)), len(ids), self.decode(ids)))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for some, _, _ in self.units.lookup([text])[0] for i in some.split(",")]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(path, pattern)


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes of every document.

    A null text is empty: no tokens, and the digests of nothing. Repeated rows give
    repeated results. ``path`` must exist on every executor. No shuffle.
    """

    def encode(batches):
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            counts, shas, decoded = [], [], []
            for _, block in in_blocks(texts):
                for units in bpe.units.lookup(block):
                    strings, lengths, raw = zip(*units, strict=True) if units else ((), (), ())
                    counts.append(sum(lengths))
                    shas.append(hashlib.sha256(",".join(strings).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(raw)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(encode, OUT)
