"""Byte-level BPE encoding and decoding (operator 2).

A pre-token's bytes form a linked list. Every adjacent pair whose joint bytes have a rank
stands in the bucket of that rank, a heap of list positions; a two-level bitmap over the
ranks finds the lowest bucket in use by find-first-set. A popped entry that no longer
describes its pair is stale and skipped. Work is near linear in the length, so pre-tokens
of millions of bytes are no special case. Short pre-tokens are memoised per worker.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MEMO_ENTRIES, _MEMO_BYTES = 400_000, 64
_BITS = 8  # ranks of a block of the lower level, as a power of two
_LOW = (1 << _BITS) - 1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: adjacent parts are joined lowest rank first, leftmost first."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts at a position; 0: joined to the part before
    before = list(range(-1, n - 1))
    # bit h of top: some rank of block h is in use; bit r & _LOW of blocks[h]: rank r is
    buckets: dict[int, list[int]] = {}
    blocks: dict[int, int] = {}
    top = 0
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                h = r >> _BITS
                blocks[h] = blocks.get(h, 0) | 1 << (r & _LOW)
                top |= 1 << h
    while top:
        h = (top & -top).bit_length() - 1
        block = blocks[h]
        rank = h << _BITS | (block & -block).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            blocks[h] = block = block & (block - 1)
            if not block:
                top &= top - 1
        j = end[i]
        if not j or j >= n:
            continue
        k = end[j]
        if get(piece[i:k]) != rank:  # stale: a side has grown since
            continue
        end[i], end[j] = k, 0
        pairs = []
        if k < n:
            before[k] = i
            pairs.append((i, end[k]))
        if (p := before[i]) >= 0:
            pairs.append((p, k))
        for p, e in pairs:
            if (r := get(piece[p:e])) is not None:
                if r in buckets:
                    heappush(buckets[r], p)
                else:
                    buckets[r] = [p]
                    h = r >> _BITS
                    blocks[h] = blocks.get(h, 0) | 1 << (r & _LOW)
                    top |= 1 << h
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@lru_cache(2)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks by token bytes, and token bytes by id, of a rank file."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


class _Memo(dict):
    """Packed ids of pre-tokens; emptied when full, and long ones aren't kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = merge(raw, self.ranks)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= _MEMO_BYTES:
            if len(self) >= _MEMO_ENTRIES:
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(2)
def _memo(path: str) -> _Memo:
    return _Memo(vocabulary(path)[0])


@lru_cache(2)
def _splitter(pattern: str):
    return regex.compile(pattern).findall


def encode(text: str | None, path: str, pattern: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers; null counts as empty."""
    return b"".join(map(_memo(path).__getitem__, _splitter(pattern)(text))) if text else b""


def decode(ids: bytes, path: str) -> bytes:
    """The bytes that packed ids stand for."""
    tokens = vocabulary(path)[1]
    return b"".join(map(tokens.__getitem__, memoryview(ids).cast("I"))) if ids else b""


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [encode(t.as_py(), path, pattern) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if x.as_py() is None else decode(x.as_py(), path) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["key", "bytes"])


def _digest_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, every = [], [], []
        for t in batch.column(1):
            ids = encode(t.as_py(), path, pattern)
            counts.append(len(ids) // 4)
            digests.append([hashlib.sha256(raw).hexdigest() for raw in (ids, decode(ids, path))])
            if keep_ids:
                every.append(ids)
        columns = [batch.column(0), pa.array(counts, pa.int64()), *(pa.array([d[k] for d in digests], pa.string()) for k in (0, 1))]
        if keep_ids:
            columns.append(pa.ListArray.from_arrays(np.cumsum([0, *counts], dtype=np.int32), np.frombuffer(b"".join(every), np.int32)))
        yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])


def _over(df: DataFrame, id_col: str, value_col: str, kind: str, step, columns: str) -> DataFrame:
    own = df.select(F.col(id_col).alias("key"), F.col(value_col).cast(kind).alias("value"))
    return own.mapInArrow(step, f"key {own.schema['key'].dataType.simpleString()}, {columns}").withColumnRenamed("key", id_col)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids)`` per row; ids are packed little-endian. Null and empty texts have none."""
    return _over(docs, id_col, text_col, "string", partial(_encode_batches, path=path, pattern=pattern), "n_tokens long, ids binary")


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes)`` per row of packed ids; null stays null."""
    return _over(tokens, id_col, ids_col, "binary", partial(_decode_batches, path=path), "bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every row and decode its ids: ``(id, n_tokens, ids_sha256, decoded_sha256)``, and ``ids`` if asked for.

    Rows are encoded each by itself, repeated ones and those without id too; null counts as empty. A text of any
    length is taken whole (its ids are held once by the task). Other columns aren't read, whatever their names.
    """
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return _over(docs, id_col, text_col, "string", partial(_digest_batches, path=path, pattern=pattern, keep_ids=keep_ids), columns)
