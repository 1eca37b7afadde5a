"""Byte-packed rows: many small keys travel through a shuffle as a few binary rows.

A stage that would emit a row for each n-gram emits instead one row for each slice and bucket, with arrays in it.
Keys repeated within a slice are sent once, so a very frequent key costs a bucket one entry a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, of the types that ``unpack`` is told, one after the other behind their lengths."""
    head = np.array([a.nbytes for a in arrays], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(types))
    out, at = [], 8 * len(types)
    for size, kind in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the high bits, which sorting keeps together."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes; of length buckets + 1."""
    return np.searchsorted(bucket_of(sorted_hashes, buckets), np.arange(buckets + 1))


def batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 4 << 20, count: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most about ``limit`` bytes of binary values."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, bytes | str))
        if size >= limit or len(held) >= count:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
