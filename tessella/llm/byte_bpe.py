"""Byte-level BPE through a sentencepiece model that is written straight from a rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.frames import small_batches

#: Unicode white space (fixed values): what ``\s`` matches in the pre-token pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: An optional space with what follows up to the next white space, or white space as the pre-token pattern cuts it. A
#: pre-token never crosses the end of such a chunk, so chunks can be encoded apart and remembered.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Chunks remembered by a worker, and the longest of them in characters.
REMEMBERED, LONGEST = 1_000_000, 64


def byte_letters() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in itself else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in the order of their ranks, which must run from 0 without gaps."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"ranks in {path} have gaps")
    return [token for _, token in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field in protobuf's wire format: a varint, a 32-bit float or length-delimited bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value % 2**64)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model whose piece ids are the ranks.

    Each token is spelled in byte letters and scored by its negative rank, so that the best-scored pair is the one of
    the lowest rank. Normalisation is the identity: no dummy prefix, no escaped or removed white space. The piece
    for unknown text comes last; it is never used, as every byte has a piece.
    """
    letters = byte_letters()
    pieces = [_field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank))) for rank, token in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    bpe, none = 2, -1
    trainer = _field(3, bpe) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encodes by the pre-token pattern and the model; decodes by the inverse of the byte letters."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.tokens = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.spell = str.maketrans({chr(b): letter for b, letter in enumerate(byte_letters())})
        back = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        self.bytes_of = [b"".join(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(len(self.tokens))]
        self.known: dict[str, bytes] = {}

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, as little-endian 32-bit numbers."""
        parts = [self.pattern.findall(chunk) for chunk in chunks]
        flat = [p.encode().decode("latin-1").translate(self.spell) for ps in parts for p in ps]
        ids = iter(self.model.encode(flat, num_threads=1)) if flat else iter(())
        return [np.array([i for _ in ps for i in next(ids)], "<u4").tobytes() for ps in parts]

    def encode(self, text: str) -> bytes:
        """Ids of ``text``, as little-endian 32-bit numbers."""
        chunks, known = CHUNK.findall(text), self.known
        found = list(map(known.get, chunks))
        if None in found:
            new = list(dict.fromkeys(c for c, f in zip(chunks, found, strict=True) if f is None))
            ids = dict(zip(new, self.encode_chunks(new), strict=True))
            found = [ids[c] if f is None else f for c, f in zip(chunks, found, strict=True)]
            if len(known) + len(ids) > REMEMBERED:
                known.clear()
            known.update((c, i) for c, i in ids.items() if len(c) <= LONGEST)
        return b"".join(found)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(2)
def encoder(path: str) -> ByteBpe:
    """One encoder for each worker process and file."""
    return ByteBpe(path)


def encode_bpe(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the array of token ids of the whole text.

    Null text counts as empty and gives an empty array. An input column named ``ids`` is replaced.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.frombuffer(encoder(path).encode(t or ""), "<u4").astype("i4") for t in texts], dtype=object)

    return docs.withColumn("ids", ids(text_col))


def decode_bpe(docs: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the bytes of the ids in ``ids_col``; null ids give null."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([None if i is None else encoder(path).decode(list(i)) for i in ids], dtype=object)

    return docs.withColumn("decoded", decoded(ids_col))


def bpe_digests(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the whole text, encoded and decoded in one pass.

    Null text counts as empty: no tokens, and the digests of nothing. Columns of these names are replaced. Repeated rows give repeated
    rows; an empty table gives an empty result.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        decimal = list(map(str, range(len(bpe.tokens))))
        for texts in batches:
            rows = []
            for text in texts:
                ids = np.frombuffer(bpe.encode(text or ""), "<u4").tolist()
                written = " ".join(map(decimal.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    text = F.col(text_col)
    return docs.select(*own, digests(text).alias("digests_")).select(*own, *[F.col("digests_").getField(n).alias(n) for n in names])
