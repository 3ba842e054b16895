"""Texts in groups of bounded size, and hashes in buckets.

A hash of text units that must be counted over the whole corpus goes from its
group to a bucket of hash space, and an answer comes back: rows are
(bucket, group, packed hashes), so a unit costs a few bytes and a frequent one
costs one entry per group, however often it occurs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import pack

GROUP_BYTES = 4 << 20
#: buckets of hash space are a power of two and hold about so many hashes
BUCKET_HASHES = 1_000_000

BLOBS = "bucket int, g int, blob binary"


def sizes(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text)."""
    r = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(r.n), int(r.b or 0)


def group_count(n_bytes: int) -> int:
    return max(1, math.ceil(n_bytes / GROUP_BYTES))


def bucket_bits(n_bytes: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n_bytes / 6 / BUCKET_HASHES))))


def to_buckets(g: int, h: np.ndarray, bits: int) -> pa.Table:
    """Rows of BLOBS for sorted hashes."""
    if bits:
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    else:
        bucket = np.zeros(len(h), np.int64)
    names, first = np.unique(bucket, return_index=True)
    ends = np.append(first[1:], len(h))
    blobs = [pack(h[a:b]) for a, b in zip(first, ends)]
    return pa.table({"bucket": pa.array(names, pa.int32()),
                     "g": pa.array(np.full(len(names), g), pa.int32()),
                     "blob": pa.array(blobs, pa.binary())})
