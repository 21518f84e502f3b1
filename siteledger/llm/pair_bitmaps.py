"""Inverted bitmaps: for each key the documents that hold it, and planes for the bits of how often they hold it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BITS = 14  # a container covers the documents whose numbers differ in these low bits alone
FULL = 1 << CHUNK_BITS >> 3  # bytes of a container in bitmap form; a sorted list of 16-bit numbers is always shorter than that
POSTINGS = pa.schema([("pair", pa.int64()), ("chunk", pa.int64()), ("plane", pa.int32()), ("bits", pa.binary())])


def pack(low: np.ndarray) -> bytes:
    """Ascending places in a chunk as a container: a list of places, or a bitmap where that is no longer."""
    if 2 * len(low) < FULL:
        return low.astype("<u2").tobytes()
    bits = np.zeros(8 * FULL, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def places(bits: bytes) -> np.ndarray:
    if len(bits) < FULL:
        return np.frombuffer(bits, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


def either(containers: list[bytes]) -> bytes:
    """The union of containers of one chunk."""
    if len(containers) == 1:
        return containers[0]
    bits = np.zeros(8 * FULL, np.uint8)
    for c in containers:
        bits[places(c)] = 1
    return pack(np.flatnonzero(bits))


def popcount(bits: bytes) -> int:
    return len(bits) >> 1 if len(bits) < FULL else int.from_bytes(bits, "little").bit_count()


def plane_weight(plane: int) -> int:
    """What a bit of a plane adds to a document's number: plane 0 marks its presence, the next ones hold the binary form of the rest."""
    return 1 << max(0, plane - 1)


def postings(pair: np.ndarray, row: np.ndarray, number: np.ndarray) -> list[pa.RecordBatch]:
    """Containers of all planes from ``number`` occurrences of ``pair`` in document ``row``; (pair, row) are distinct."""
    order = np.lexsort((row, pair))
    pair, row, rest = pair[order], row[order], number[order].astype(np.int64) - 1
    out = [_plane(pair, row, 0)]
    for bit in range(int(rest.max(initial=0)).bit_length()):
        held = (rest >> bit & 1).astype(bool)
        out.append(_plane(pair[held], row[held], bit + 1))
    return out


def _plane(pair: np.ndarray, row: np.ndarray, plane: int) -> pa.RecordBatch:
    chunk, low = row >> CHUNK_BITS, row & ((1 << CHUNK_BITS) - 1)
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (chunk[1:] != chunk[:-1])
    head = np.flatnonzero(new)
    ends = np.append(head[1:], len(pair))
    bits = [pack(low[a:b]) for a, b in zip(head.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(pair[head]), pa.array(chunk[head]), pa.array(np.full(len(head), plane, np.int32)), pa.array(bits, pa.binary())], schema=POSTINGS)
