"""Compressed bitmaps over 32,768 positions: the smallest of a sorted array, runs, and a dense bitmap."""

from __future__ import annotations

import numpy as np

BITS = 15
WIDTH = 1 << BITS
ARRAY, RUNS, DENSE = "array", "runs", "dense"


def compress(places: np.ndarray) -> tuple[str, bytes]:
    """(form, bytes) of distinct positions in 0..WIDTH-1, in any order."""
    places = np.sort(np.asarray(places, np.uint16))
    breaks = np.flatnonzero(np.diff(places.astype(np.int64)) != 1) + 1
    runs = len(breaks) + 1 if len(places) else 0
    smallest = min((2 * len(places), ARRAY), (4 * runs, RUNS), (WIDTH // 8, DENSE))[1]
    if smallest == ARRAY:
        return ARRAY, places.tobytes()
    if smallest == RUNS:
        first = places[np.concatenate(([0], breaks))]
        last = places[np.concatenate((breaks - 1, [len(places) - 1]))]
        return RUNS, np.stack((first, last), axis=1).tobytes()
    bits = np.zeros(WIDTH, bool)
    bits[places] = True
    return DENSE, np.packbits(bits, bitorder="little").tobytes()


def dense(form: str, data: bytes) -> np.ndarray:
    """The dense bitmap (WIDTH / 8 bytes) of a compressed one."""
    if form == DENSE:
        return np.frombuffer(data, np.uint8)
    numbers = np.frombuffer(data, np.uint16).astype(np.int64)
    if form == ARRAY:
        bits = np.zeros(WIDTH, bool)
        bits[numbers] = True
    else:
        edges = np.zeros(WIDTH + 1, np.int64)
        edges[numbers[0::2]] += 1
        edges[numbers[1::2] + 1] -= 1
        bits = np.cumsum(edges[:-1]) > 0
    return np.packbits(bits, bitorder="little")


def positions_of(bitmap: np.ndarray) -> np.ndarray:
    """The positions of a dense bitmap's bits, in order."""
    return np.flatnonzero(np.unpackbits(bitmap, bitorder="little"))
