"""Whole numbers as compressed byte planes, for rows that carry many of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

_PACK = zstandard.ZstdCompressor(level=1)
_OPEN = zstandard.ZstdDecompressor()


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers of at least zero, as few bytes wide as the largest needs. Of ``rising``
    ones the differences are kept."""
    numbers = np.asarray(values, np.int64)
    if rising:
        numbers = np.diff(numbers, prepend=0)
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return _PACK.compress(bytes([width]) + planes.tobytes())


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(_OPEN.decompress(data), np.uint8)
    planes = raw[1:].reshape(int(raw[0]), -1)
    numbers = np.zeros(planes.shape[1], np.int64)
    for i, plane in enumerate(planes):
        numbers |= plane.astype(np.int64) << np.int64(8 * i)
    return np.cumsum(numbers) if rising else numbers


def pack_floats(values: np.ndarray) -> bytes:
    return _PACK.compress(b"f" + np.asarray(values, "<f8").tobytes())


def unpack_floats(data: bytes) -> np.ndarray:
    return np.frombuffer(_OPEN.decompress(data)[1:], "<f8")


def pack_words(words: list[bytes]) -> bytes:
    """Words that hold no space."""
    return _PACK.compress(b" ".join([*words, b""]))


def unpack_words(data: bytes) -> list[bytes]:
    return _OPEN.decompress(data).split(b" ")[:-1]


def slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of slices, one slice after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + lengths, lengths) + np.arange(total)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads numbers over 62 bits, to deal them out."""
    x = np.asarray(values).astype(np.uint64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(33))) >> np.uint64(2)).astype(np.int64)


def one_list(values: pa.Array) -> pa.ListArray:
    """A column of a single row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
