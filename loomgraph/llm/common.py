"""What the operators of this folder share: folds, bounded labelled samples, Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above every unsigned 63-bit sample hash.
_HASH_SPAN = float(1 << 63)


def fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id is in no fold (null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def in_fold(col: str, mod: int, rest: int) -> Column:
    return F.coalesce(fold(col, mod) == rest, F.lit(False))


def struct_name(taken, name: str) -> str:
    """``name`` with as many underscores in front as make it and all that starts so free of ``taken`` columns."""
    known = [c.lower() for c in taken]
    while any(c.startswith(f"_{name}".lower()) for c in known):
        name = f"_{name}"
    return f"_{name}"


def sample_labelled(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, max_chars: int
) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """At most about ``per_class`` whole texts for each value 0 and 1 of ``label``, and the class counts.

    ``keep`` says which label rows may be used.  The rows are chosen by a hash of the id, so the
    choice is the same on every run; texts over ``max_chars`` characters aren't sampled.  Only this
    bounded sample comes to the driver.
    """
    known = (
        labels.where(keep & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
    )
    counts = {int(r.y): int(r.n) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("doc_id")), 1) / F.lit(_HASH_SPAN)
    chosen = F.broadcast(known.where(draw < share).limit(4 * per_class))  # of a size that the parameter bounds
    rows = (
        docs.select("doc_id", "text")
        .where(F.length("text").between(1, max_chars))
        .join(chosen, "doc_id")
        .select(F.col("text").cast("binary").alias("text"), "y", "doc_id")
        .limit(4 * per_class)
        .collect()
    )
    rows.sort(key=lambda r: (r.doc_id, bytes(r.text)))
    return [(bytes(r.text), int(r.y)) for r in rows], counts


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pack(values: np.ndarray) -> bytes:
    """Numbers as zstd-compressed byte planes, which suits sorted or small values."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers, as steps."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def logistic(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the last coefficient is the constant."""
    a = np.column_stack([x, np.ones(len(x))])
    w = weight / weight.sum()
    beta = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = logistic(a @ beta)
        grad = a.T @ (w * (p - y)) + ridge * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta
