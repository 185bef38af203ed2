"""Byte-level BPE through a sentencepiece model that is serialised straight from the vocabulary.

Every byte becomes one printable character, every token the string of its bytes' characters, scored by its
negative rank; the normaliser is the identity. Merging the best-scored pair first is then merging the lowest
rank first. Pre-tokens are the matches of a pattern, encoded one by one; decoding maps pieces back to bytes.

A null text is an empty one, with no ids. Equal rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a worker remembers; the memory is emptied when full, which changes no result.
ROOM = 400_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model: ids are ranks; the unknown piece comes after them."""
    chars = byte_characters()
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))
    normal, unknown, bpe = 1, 2, 2
    body = b"".join(piece("".join(chars[b] for b in t), -float(rank), normal) for rank, t in enumerate(tokens))
    body += piece("<unk>", 0.0, unknown)
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes in a worker. Ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.of_byte = dict(enumerate(byte_characters()))
        self.tokens, self.known = tokens, {}

    def _learn(self, new: list[str]) -> None:
        mapped = [t.encode().decode("latin-1").translate(self.of_byte) for t in new]
        pack = struct.pack
        for t, ids in zip(new, self.model.encode(mapped, out_type=int, num_threads=1)):
            self.known[t] = pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        parts, known = self.find(text), self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            pass
        different = dict.fromkeys(parts)
        new = [t for t in different if t not in known]
        if len(known) + len(new) > ROOM:
            known.clear()
            new = list(different)
        if len(new) <= ROOM:
            self._learn(new)
            return b"".join(map(known.__getitem__, parts))
        out = []  # more different pre-tokens in one text than are remembered at once
        for i in range(0, len(parts), ROOM):
            known.clear()
            self._learn(list(dict.fromkeys(parts[i : i + ROOM])))
            out += map(known.__getitem__, parts[i : i + ROOM])
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _vocabulary(path: str | None, pattern: str | None) -> tuple[list[bytes], str]:
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN


def encoded(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, keep_ids: bool = True, keep_decoded: bool = True) -> DataFrame:
    """doc_id, ids (array), decoded (the text of the decoded bytes), and the digests of both."""
    tokens, pattern = _vocabulary(path, pattern)
    shared = df.sparkSession.sparkContext.broadcast((model_bytes(tokens), tokens, pattern))
    kind = dict(df.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for value in batch.column(1):
                ids = codec.encode(value.as_py() or "")
                back = codec.decode(ids)
                rows["n_tokens"].append(len(ids) // 4)
                rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                if keep_ids:
                    rows["ids"].append(np.frombuffer(ids, "<i4"))
                if keep_decoded:
                    rows["decoded"].append(back.decode("utf-8", "replace"))
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            names = [k for k, v in rows.items() if k in schema.replace(",", "").split()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[k], kinds.get(k, pa.string())) for k in names]], ["doc_id", *names])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def report(df: DataFrame, **options) -> DataFrame:
    return encoded(df, keep_ids=False, keep_decoded=False, **options)
