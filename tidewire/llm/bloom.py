"""Bloom filters of 64-bit keys, built in segments by Spark tasks and probed in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_BITS = 1 << 18
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mixed(keys: np.ndarray, k: int = 0) -> np.ndarray:
    x = keys.view(np.uint64) if keys.dtype == np.int64 else keys
    x = (x ^ (x >> np.uint64(30))) * _MIX[k % 4]
    x = (x ^ (x >> np.uint64(27))) * _MIX[(k + 1) % 4]
    return x ^ (x >> np.uint64(31))


def segments_for(n: int, bits_per_key: int, max_bytes: int) -> int:
    """Segments (a power of two) of a filter of n keys, never more than max_bytes in all."""
    most = max(1, 8 * max_bytes // SEGMENT_BITS)
    need = max(1, -(-n * bits_per_key // SEGMENT_BITS))
    return min(1 << (need - 1).bit_length(), 1 << (most.bit_length() - 1))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mixed(keys) & np.uint64(segments - 1)).astype(np.int64)


def places(keys: np.ndarray, probes: int) -> list[np.ndarray]:
    """Bit of each key in its segment, for each probe."""
    a, b = mixed(keys, 1), mixed(keys, 2) | np.uint64(1)
    return [((a + np.uint64(k) * b) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64) for k in range(probes)]


def segment_bits(keys: np.ndarray, probes: int) -> bytes:
    bits = np.zeros(SEGMENT_BITS, np.uint8)
    for at in places(keys, probes):
        bits[at] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Bloom:
    def __init__(self, parts: dict[int, bytes], segments: int, probes: int):
        self.segments, self.probes = segments, probes
        empty = bytes(SEGMENT_BITS // 8)
        self.bits = np.frombuffer(b"".join(parts.get(k, empty) for k in range(segments)), np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        base = segment_of(keys, self.segments) * SEGMENT_BITS
        found = np.ones(len(keys), bool)
        for at in places(keys, self.probes):
            at = base + at
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return found


def bloom_of(keys: DataFrame, n: int, bits_per_key: int = 16, probes: int = 2, max_bytes: int = 16 << 20) -> Bloom:
    """Filter of a column `key` (long, n rows); its size is bounded by max_bytes, beyond which
    it passes more keys that it does not hold, never fewer that it holds."""
    segments = segments_for(n, bits_per_key, max_bytes)

    @F.pandas_udf("long")
    def segment(key: pd.Series) -> pd.Series:
        return pd.Series(segment_of(key.to_numpy(np.int64), segments))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"segment": group.segment[:1], "bits": [segment_bits(group.key.to_numpy(np.int64), probes)]})

    rows = keys.select("key", segment("key").alias("segment")).groupBy("segment").applyInPandas(build, "segment long, bits binary").collect()
    return Bloom({r.segment: bytes(r.bits) for r in rows}, segments, probes)
