"""Normalisation by a model's compiled character map, with the source of each character."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from pageloom.llm.piece_model import SPACE, load


class Normaliser:
    """The character map: a double array over UTF-8 bytes and the replacements."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, trim: bool):
        self.dummy_prefix, self.trim = dummy_prefix, trim
        size = struct.unpack_from("<I", charsmap)[0] if charsmap else 0
        self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4) if charsmap else ()
        self.targets = charsmap[4 + size :]
        self._rules: dict[str, str | None] = {}

    def _longest(self, data: bytes) -> tuple[int, int] | None:
        """Bytes and target of the longest rule at the beginning of ``data``."""
        units, best = self.units, None
        node = 0
        offset = self._offset(units[0])
        for i, byte in enumerate(data):
            node = (node ^ offset) ^ byte if i == 0 else node ^ byte
            if node >= len(units) or (units[node] & 0x800000FF) != byte:
                return best
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (i + 1, units[node] & 0x7FFFFFFF)
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _steps(self, text: str) -> Iterator[tuple[str, int]]:
        """Replacement and number of source bytes, place by place."""
        data, at = text.encode(), 0
        while at < len(data):
            found = self._longest(data[at : at + 64]) if self.units else None
            if found:
                end = self.targets.index(b"\0", found[1])
                yield self.targets[found[1] : end].decode(), found[0]
                at += found[0]
            else:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                yield data[at : at + size].decode(), size
                at += size

    def text(self, text: str) -> str:
        """The normalised text alone."""
        if self.units or self.trim:
            return self.aligned(text)[0]
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def aligned(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """Normalised text, and begin and end byte of each of its characters' source."""
        out: list[str] = []
        begins: list[int] = []
        ends: list[int] = []
        at = 0
        for target, size in self._steps(text):
            for char in target.replace(" ", SPACE):
                if self.trim and char == SPACE and (not out or out[-1] == SPACE):
                    continue
                out.append(char)
                begins.append(at)
                ends.append(at + size)
            at += size
        while self.trim and out and out[-1] == SPACE:
            out.pop(), begins.pop(), ends.pop()
        if self.dummy_prefix and out:
            out.insert(0, SPACE), begins.insert(0, begins[0]), ends.insert(0, begins[1])
        return "".join(out), np.array(begins, np.int64), np.array(ends, np.int64)


@lru_cache(maxsize=2)
def normaliser(path: str) -> Normaliser:
    model = load(path)
    return Normaliser(model.charsmap, model.dummy_prefix, model.trim)
