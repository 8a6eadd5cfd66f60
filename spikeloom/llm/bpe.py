"""Byte-level BPE by a sentencepiece model written straight from a rank file.

Each vocabulary entry becomes a piece whose bytes are mapped one to one onto
printable characters, with the negative rank as its score, so sentencepiece's
best-score-first merges are the rank order. The normaliser is the identity.
Texts are cut by the tokenizer's pattern and every match is encoded on its own;
decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm import text as X

#: Distinct matches whose ids one worker remembers; longer matches than CACHED_CHARS are never kept.
CACHE = 400_000
CACHED_CHARS = 48
#: Printable stand-ins for the 256 bytes: 256 letters that are neither blanks nor sentencepiece's own markers.
BYTE_CHARS = "".join(chr(0x4E00 + k) for k in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file in rank order; ranks must be 0, 1, 2, ... without gaps."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f) if a}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[k] for k in range(len(ranks))]


def model_bytes(entries: list[bytes]) -> bytes:
    """A serialised sentencepiece model: piece k + 1 is entry k, piece 0 the unknown piece."""
    name = lambda e: "".join(BYTE_CHARS[b] for b in e).encode()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, name(e)) + _field(2, float(-k)) + _field(3, 1) for k, e in enumerate(entries)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normal)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str):
        entries = read_ranks(path)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(entries))
        self.find = regex.compile(pattern).findall
        self.known: dict[str, str] = {}
        self.length = np.array([len(e) for e in entries], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def learn(self, tokens: set[str]) -> dict[str, str]:
        """Remember the ids, as decimal text, of matches seen for the first time; long ones come back apart."""
        if len(self.known) > CACHE:
            self.known.clear()
        new = [t for t in tokens if t not in self.known]
        ids = self.sp.encode([t.encode().decode("latin-1").translate(_SHOWN) for t in new], num_threads=1) if new else []
        said = {t: " ".join([str(i - 1) for i in x]) for t, x in zip(new, ids, strict=True)}
        self.known.update((t, s) for t, s in said.items() if len(t) <= CACHED_CHARS)
        return {t: s for t, s in said.items() if len(t) > CACHED_CHARS}

    def encode(self, text: str) -> str:
        """Ids of a text as decimal numbers joined by blanks."""
        tokens = self.find(text)
        known = self.known
        try:
            return " ".join([known[t] for t in tokens])
        except KeyError:
            apart = self.learn(set(tokens))
            return " ".join([apart[t] if t in apart else known[t] for t in tokens])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[X.gather(self.length[ids], self.at[ids])].tobytes()


_SHOWN = {k: c for k, c in enumerate(BYTE_CHARS)}


@lru_cache(2)
def codec_of(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def byte_bpe(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every text and decode it again: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded).

    path: a rank file in a place that every executor can read. pattern: the
    pre-token pattern; text that it doesn't match has no tokens. Null counts
    as empty: no ids, and the digest of nothing. One row per input row. The
    model's memory of matches is bounded, whatever the text.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def code(batches):
        codec = codec_of(path, pattern)
        for b in batches:
            n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for v in b.column("text"):
                said = codec.encode(v.as_py() or "")
                ids = np.fromstring(said, np.int64, sep=" ") if said else np.zeros(0, np.int64)
                data = codec.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(said.encode()).hexdigest())
                text_sha.append(hashlib.sha256(data).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32)), all_text.append(data)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            cols += [pa.array(all_ids, pa.list_(pa.int32())), X.blobs(all_text)] * with_ids
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(code, schema)
