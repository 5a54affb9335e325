"""Bloom filters of bounded size, built in parallel and merged segment by segment.

A filter is a pair of bit maps: slots hit at least once and slots hit at least twice. Each task keeps its own pair,
a bit a slot, and emits the segments that are not empty; segments are merged as a stream, so the memory of a merging
task is its share of the filter, whatever the number of rows. A key all of whose slots were hit twice is *possibly
repeated*, any other key is certainly unique. More keys than one map serves are dealt by their digests over parts,
each with a map of its own (``parts_of``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each key, and the largest map (64 MB); keys that need more are dealt over several.
BITS_PER_KEY = 16
MAX_BITS = 1 << 29
SEGMENTS = 16


def filter_bits(n_keys: int, max_bits: int = MAX_BITS) -> int:
    bits = 1 << 15
    while bits < BITS_PER_KEY * n_keys and bits < max_bits:
        bits <<= 1
    return bits


def parts_of(n_keys: int, max_bits: int = MAX_BITS) -> int:
    """The number of maps of ``max_bits`` bits that ``n_keys`` keys need."""
    return max(1, -(-BITS_PER_KEY * n_keys // max_bits))


def slots_of(keys: list[bytes], bits: int) -> np.ndarray:
    """Two slots of each digest (16 bytes at least)."""
    if not keys:
        return np.zeros((0, 2), np.int64)
    words = np.frombuffer(b"".join(k[:16] for k in keys), "<u8").reshape(-1, 2)
    return (words & np.uint64(bits - 1)).astype(np.int64)


def repeated_map(keys: DataFrame, column: str, n_keys: int, max_bits: int = MAX_BITS) -> tuple[np.ndarray, int]:
    """First pass: the bit map of slots that were hit twice, and its number of bits."""
    bits = filter_bits(n_keys, max_bits)
    width = bits // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            # The two slots of a key may coincide: it then hits that slot once.
            pair = slots_of(batch.column(0).to_pylist(), bits)
            hit = np.concatenate([pair[:, 0], pair[pair[:, 0] != pair[:, 1], 1]])
            slot, times = np.unique(hit, return_counts=True)
            if not len(slot):
                continue
            # The slots of one byte are neighbours: their bits are joined, then set together.
            byte, first = np.unique(slot >> 3, return_index=True)
            bit = (128 >> (slot & 7)).astype(np.uint8)
            twice[byte] |= (once[byte] & np.bitwise_or.reduceat(bit, first)) | np.bitwise_or.reduceat(np.where(times > 1, bit, 0).astype(np.uint8), first)
            once[byte] |= np.bitwise_or.reduceat(bit, first)
        rows = [(s, once[s * width // 8 : (s + 1) * width // 8], twice[s * width // 8 : (s + 1) * width // 8]) for s in range(SEGMENTS)]
        rows = [(s, zlib.compress(a.tobytes(), 1), zlib.compress(b.tobytes(), 1)) for s, a, b in rows if a.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if s in kept:
                    kept[s][1] |= b | (kept[s][0] & a)
                    kept[s][0] |= a
                else:
                    kept[s] = [a.copy(), b.copy()]
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([zlib.compress(v[1].tobytes(), 1) for v in kept.values()], pa.binary())], names=["segment", "twice"])

    parts = keys.select(column).mapInArrow(count, "segment int, once binary, twice binary")
    merged = parts.repartition(SEGMENTS, "segment").mapInArrow(merge, "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # at most SEGMENTS rows, MAX_BITS / 8 bytes in all
        out[row["segment"] * width // 8 : (row["segment"] + 1) * width // 8] = np.frombuffer(zlib.decompress(bytes(row["twice"])), np.uint8)
    return out, bits


def flag_repeated(spark: SparkSession, keys: DataFrame, column: str, found: tuple[np.ndarray, int]) -> DataFrame:
    """Second pass: ``keys`` with a column ``maybe_repeated``."""
    bits = found[1]
    shared = spark.sparkContext.broadcast(found[0])  # bounded by MAX_BITS
    at = keys.columns.index(column)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            slots = slots_of(batch.column(at).to_pylist(), bits)
            hit = (bitmap[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.all(axis=1), pa.bool_())], names=[*batch.schema.names, "maybe_repeated"])

    return keys.mapInArrow(flag, keys.withColumn("maybe_repeated", F.lit(True)).schema)
