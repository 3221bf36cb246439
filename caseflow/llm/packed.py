"""Rows whose columns are packed arrays: what blocks and parts of a corpus send each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CODEC = "zstd"
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def pack(a: np.ndarray) -> bytes:
    """Whole numbers or doubles, in the fewest bytes each, like bytes side by side, compressed."""
    if a.dtype != np.float64:
        most = int(a.max()) if len(a) else 0
        a = a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    head = np.array([a.itemsize + (16 if a.dtype == np.float64 else 0), len(a)], np.int64).tobytes()
    return head + (pa.compress(raw, codec=CODEC, asbytes=True) if raw else b"")


def unpack(b: bytes) -> np.ndarray:
    """What pack() was given, as 64-bit numbers."""
    kind, n = np.frombuffer(b, np.int64, 2)
    size = int(kind) & 15
    raw = pa.decompress(b[16:], decompressed_size=size * int(n), codec=CODEC, asbytes=True) if n else b""
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, int(n)).T)
    return a.reshape(-1).view(np.float64) if kind > 16 else a.reshape(-1).view(f"u{size}").astype(np.uint64)


def pack_texts(texts: list[str]) -> bytes:
    data = "".join(texts).encode()
    sizes = pack(np.array([len(t) for t in texts], np.int64))
    head = np.array([len(sizes), len(data)], np.int64).tobytes()
    return head + sizes + (pa.compress(data, codec=CODEC, asbytes=True) if data else b"")


def unpack_texts(b: bytes) -> list[str]:
    at, size = (int(x) for x in np.frombuffer(b, np.int64, 2))
    text = pa.decompress(b[16 + at :], decompressed_size=size, codec=CODEC, asbytes=True).decode() if size else ""
    ends = np.cumsum(unpack(b[16 : 16 + at]).astype(np.int64)).tolist()
    return [text[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def table_of(schema: str, rows: list[dict]) -> pa.Table:
    """A table of rows; schema as Spark writes it, of the KINDS above."""
    fields = [c.split() for c in schema.split(", ")]
    return pa.table({k: pa.array([r.get(k) for r in rows], KINDS[t]) for k, t in fields})


def rows_of(x: pa.Table | pa.RecordBatch) -> list[dict]:
    return x.to_pylist()
