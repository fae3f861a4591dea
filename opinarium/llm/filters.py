"""Bloom filters of a fixed size, built in segments so that no task or driver holds more than one filter."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Segments, by the highest 12 bits of a hash.
SEGMENT_BITS = 12
SEGMENTS = 1 << SEGMENT_BITS


def segment_of(column: str):
    """Segment of a hash column."""
    return F.shiftrightunsigned(column, 64 - SEGMENT_BITS).cast("int")


def mixed(h: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each 64-bit value."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def unmixed(h: np.ndarray) -> np.ndarray:
    """The values that ``mixed`` made ``h`` of; it loses none."""
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h = h * np.uint64(pow(0x94D049BB133111EB, -1, 2**64))
    h = (h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


def bits_of(h: np.ndarray, log_bits: int, probes: int) -> np.ndarray:
    """Bits of each hash in a filter of ``2 ** log_bits`` bits: all in the segment of the hash."""
    inner = log_bits - SEGMENT_BITS
    mask = np.uint64((1 << inner) - 1)
    base = (h >> np.uint64(64 - SEGMENT_BITS)) << np.uint64(inner)
    step = h
    out = np.empty((probes, len(h)), np.uint64)
    for i in range(probes):
        out[i] = base | (step & mask)
        step = mixed(step + np.uint64(i + 1))
    return out


def contains(packed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether all bits (``probes`` x ``n``) are set in a packed filter."""
    hit = np.ones(bits.shape[1], bool)
    for row in bits:
        hit &= (packed[row >> np.uint64(3)] >> (row & np.uint64(7)).astype(np.uint8)) & 1 != 0
    return hit


def build_filter(hashes: DataFrame, log_bits: int, probes: int = 2) -> np.ndarray:
    """Packed filter of the bigint column ``hash``: ``2 ** log_bits`` bits, whatever the number of rows.

    Rows are dealt out by segment; a task sets the bits of its segments and passes them on compressed.
    """
    inner = log_bits - SEGMENT_BITS
    size = (1 << inner) // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = bits_of(h, log_bits, probes).ravel()
            places = bits >> np.uint64(inner)
            order = np.argsort(places, kind="stable")
            starts = np.flatnonzero(np.diff(places[order], prepend=np.uint64(2**63)))
            for own in np.split(order, starts[1:]) if len(order) else ():
                part = parts.setdefault(int(places[own[0]]), np.zeros(size, np.uint8))
                inside = bits[own] & np.uint64((1 << inner) - 1)
                np.bitwise_or.at(part, inside >> np.uint64(3), np.uint8(1) << (inside & np.uint64(7)).astype(np.uint8))
        for segment, part in parts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())],
                ["segment", "bits"],
            )

    dealt = hashes.select("hash").repartition(segment_of("hash"))
    packed = np.zeros((1 << log_bits) // 8, np.uint8)
    # All segments together are one filter, so one job may bring them.
    for row in dealt.mapInArrow(fill, "segment int, bits binary").collect():
        packed[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return packed
