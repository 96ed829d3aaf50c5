"""Reproducible shuffle and sharding: a keyed Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import ranked

ROUNDS = 6
_M, _N = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M
    x = (x ^ (x >> np.uint64(27))) * _N
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0..n-1, applied to x, or its inverse.

    A balanced Feistel network permutes the smallest domain of 4 ** h >= n numbers; values that leave 0..n-1 are permuted
    again until they are back (cycle walking, under 4 steps in the mean).
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1)))
    if inverse:
        keys = keys[::-1]

    def once(v):
        left, right = v >> bits, v & mask
        if inverse:
            left, right = right, left
        for key in keys:
            left, right = right, left ^ (_mix(right + key) & mask)
        return (right << bits) | left if inverse else (left << bits) | right

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def place(row: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers, computed without any table."""
    at = permute(row, n, seed)
    return at % shards, at // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The global row number that lies in a slot of a shard: random access into the shuffled order."""
    return permute(slot * shards + shard, n, seed, inverse=True)


def shard(docs: DataFrame, shards: int, seed: int = 2026, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row, shard, slot) for each row of docs.

    Rows are numbered in the order (id, crc32, size); nulls come first; rows alike in all three are interchangeable. The
    permuted number modulo `shards` is the shard, the quotient the slot: counts differ by one at most, slots have no gaps,
    and place() gives both from a row number alone. size: UTF-8 bytes of the text (null: none) plus 16. No rows: none out.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = ranked(slim, ["doc_id", "text_crc32", "size"], "row")
    n = rows.count()

    def run(batches):
        for batch in batches:
            row = batch.column("row").to_numpy()
            s, t = place(row, n, shards, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.astype(np.int32)), pa.array(t)], [*batch.schema.names, "shard", "slot"])

    return rows.select("doc_id", "size", "text_crc32", "row").mapInArrow(run, "doc_id long, size long, text_crc32 long, row long, shard int, slot long")
