"""Word shingles of Arrow texts as sets of 64-bit hashes, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
SLICE_BYTES = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of about ``most_bytes``; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(texts)]
    for begin, end in zip(cuts, cuts[1:]):
        if end > begin:
            yield texts.slice(begin, end - begin)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bytes of each word (A-Z lower-cased, cut at ASCII white space) of all texts
    in one array, and where each text's words begin, with the end as last."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = lists.values, lists.offsets.to_numpy()
    words = words.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False)
    full = sizes > 0
    before = np.concatenate([[0], np.cumsum(full)])
    coded = words.dictionary_encode()
    seen = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
    codes = coded.indices.to_numpy()
    return hashes[codes][full], sizes[full], before[offsets]


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``words`` words. A text
    with fewer words has all of them as one run; one without words an empty set."""
    for part in slices(texts):
        hashes, _, starts = word_hashes(part)
        runs = hashes.copy()
        for i in range(1, words):
            runs[:-i] = runs[:-i] * _STEP + hashes[i:]
        runs = mixed(runs + np.uint64(words * int(_STEP) & _MASK))
        for begin, end in zip(starts.tolist(), starts[1:].tolist()):
            if end - begin >= words:
                yield np.unique(runs[begin : end - words + 1])
            elif end > begin:
                short = 0
                for h in hashes[begin:end].tolist():
                    short = (short * int(_STEP) + h) & _MASK
                yield mixed(np.array([(short + (end - begin) * int(_STEP)) & _MASK], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
