"""Arrow texts as bytes in NumPy, in windows of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array and where each text begins, with the end as
    last. NULL counts as empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def windows(offsets: np.ndarray, size: int = WINDOW) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, texts, cuts): parts of at most ``size`` bytes, the texts that have
    bytes in them and where those begin within the part. Long texts span parts."""
    full = np.flatnonzero(np.diff(offsets))
    begins, ends = offsets[full], offsets[full + 1]
    for begin in range(0, int(offsets[-1]), size):
        end = min(begin + size, int(offsets[-1]))
        first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(begins, end, "left")
        yield begin, end, full[first:last], np.maximum(begins[first:last] - begin, 0)
