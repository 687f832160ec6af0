"""Vector tables: which rows take part, and one row for each distinct vector."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.llm.common import small_batches


def keyed(vectors: DataFrame, narrow: bool = False) -> DataFrame:
    """(vec_id, key, vector): key is a digest of the vector, null where it takes no part.

    Vectors that are null, empty, zero or hold null or non-finite components take no part. Shorter vectors count
    as followed by zeros; trailing zeros don't change a key. With ``narrow``, vectors that floats hold exactly are
    packed as floats and one byte more, which tells them from doubles.
    """

    def run(batches):
        for batch in batches:
            keys, packed = [], []
            for value in batch.column("embedding").to_pylist():
                x = np.array([np.nan if c is None else c for c in value or ()], np.float64)
                x = np.trim_zeros(x, "b") + 0.0
                with np.errstate(over="ignore"):
                    fits = len(x) and np.isfinite(x).all() and 0 < x @ x < np.inf
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if fits else None)
                packed.append(_pack(x, narrow) if fits else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["vec_id", "key", "vector"])

    small_batches(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, key binary, vector binary")


def _pack(x: np.ndarray, narrow: bool) -> bytes:
    if narrow:
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        if (short == x).all():
            return short.tobytes() + b"f"
    return x.tobytes()


def width(packed) -> Column:
    """Components of a packed vector."""
    size = F.octet_length(packed)
    return F.when(size % 8 == 0, size / 8).otherwise((size - 1) / 4).cast("int")


def matrix(packed: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows of one matrix, zeros to the right."""
    out = np.zeros((len(packed), dim))
    for i, p in enumerate(packed):
        x = np.frombuffer(p, np.float64 if len(p) % 8 == 0 else np.float32, len(p) // 8 if len(p) % 8 == 0 else len(p) // 4)
        out[i, : len(x)] = x
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
