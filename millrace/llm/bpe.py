"""Byte-level BPE encoding and decoding with a local rank file.

``Codec`` wraps the tiktoken library; ``encode`` and ``decode`` are the
DataFrame forms. Long texts are pre-split at boundaries where the pattern must
end a match, so each piece encodes as it would inside the whole text.

Null and empty texts encode to no ids. Rows are independent: repeated rows,
ties and extra columns need no care.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import tiktoken
from pyspark.sql import DataFrame

from millrace.llm.common import map_slices

#: Texts longer than this many characters are encoded in pieces of about this size.
PIECE = 100_000
#: A safe end: a letter or digit before white space. No alternative of the pattern
#: joins white space to what stands before it, and the look-ahead after white space
#: only looks forward.
_SAFE = re.compile(r"(?<=[^\W_])(?=[ \t\n\r])")
#: Within a long run of spaces before a word, the place before the last space.
_RUN = re.compile(r"(?<= {64})(?= [^\s])")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in pieces whose encodings, joined, are the encoding of text."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size) or _RUN.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Codec:
    """Encodes and decodes by the ranks in ``rank_file`` (its bytes) and a pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}
        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= PIECE:
            return self._encoding.encode_ordinary(text)
        out: list[int] = []
        for piece in pieces(text):
            out += self._encoding.encode_ordinary(piece)
        return out

    def decode(self, ids: list[int] | None) -> bytes:
        return self._encoding.decode_bytes(ids) if ids else b""


@functools.lru_cache(maxsize=2)
def _codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def _shipped(df: DataFrame, rank_path: str):
    """The rank file goes to the executors as a broadcast: its size is that of a vocabulary, not of the data."""
    with open(rank_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of int) for every row of df."""
    ranks = _shipped(df, rank_path)

    def start():
        codec = _codec(ranks.value, pattern)
        return lambda ids, texts: (ids, [codec.encode(t) for t in texts])

    return map_slices(df, [doc_id, text], f"{doc_id} {df.schema[doc_id].dataType.simpleString()}, ids array<int>", start)


def decode(df: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and ``bytes`` (binary) for every row of df; null ids decode to no bytes."""
    ranks = _shipped(df, rank_path)

    def start():
        codec = _codec(ranks.value, pattern)
        return lambda keys, lists: (keys, [codec.decode(x) for x in lists])

    return map_slices(df, [doc_id, ids], f"{doc_id} {df.schema[doc_id].dataType.simpleString()}, bytes binary", start, text=None)


def round_trip(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Encode and decode each text in one pass and keep the digests, so that ids
    needn't pass through the JVM: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks = _shipped(df, rank_path)

    def start():
        codec = _codec(ranks.value, pattern)

        def step(keys, texts):
            n, a, b = [], [], []
            for t in texts:
                ids = codec.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return keys, n, a, b

        return step

    return map_slices(df, ["doc_id", "text"], "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start)
