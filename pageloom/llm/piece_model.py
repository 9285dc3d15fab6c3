"""Reading a SentencePiece BPE model file: pieces, scores, normaliser settings, merges."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

SPACE = "▁"

# Fixed values of the model format: piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield number, data[at : at + size]
        at += size


@dataclass(frozen=True)
class PieceModel:
    pieces: list[str]
    types: list[int]
    scores: dict[str, float]  # of the pieces that merges may make
    ids: dict[str, int]
    byte_ids: dict[int, int]
    unknown: int
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True  # remove_extra_whitespaces
    longest: int = field(default=1)  # characters of the longest piece
    segments: re.Pattern = field(default=re.compile("(?s).+"))  # parts no piece crosses


def cutter(pieces: list[str]) -> re.Pattern:
    """Matches parts of a normalised text between which no piece can lie: spaces with the
    letters, or with the other characters, that follow. Where some piece does hold a
    letter next to another character, only spaces are cut at."""
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:]) if SPACE not in (a, b)}
    if any(a.isalpha() != b.isalpha() for a, b in pairs):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    # What the pattern's letters hold besides; characters of no piece may fall either way.
    odd = "".join(sorted(c for c in set("".join(pieces)) if re.match(r"[^\W\d_]", c) and not c.isalpha()))
    return re.compile(rf"{SPACE}*[^\W\d_{odd}]+|{SPACE}*(?:(?!{SPACE})[\W\d_{odd}])+|{SPACE}+")


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    """The model at ``path``. Only BPE models with byte fallback and without
    user-defined pieces are taken; others raise ValueError."""
    pieces, types, scores = [], [], []
    charsmap, dummy_prefix, trim, escape = b"", True, True, True
    kind = fallback = 0
    with open(path, "rb") as file:
        data = file.read()
    for number, value in _fields(data):
        if number == 1:
            piece, score, type_ = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    type_ = v
            pieces.append(piece)
            types.append(type_)
            scores.append(score)
        elif number == 2:
            settings = dict(_fields(value))
            kind, fallback = settings.get(3, 1), settings.get(35, 0)
        elif number == 3:
            settings = dict(_fields(value))
            charsmap = settings.get(2, b"")
            dummy_prefix, trim = bool(settings.get(3, 1)), bool(settings.get(4, 1))
            escape = bool(settings.get(5, 1))
    if kind != 2 or not fallback or not escape or USER_DEFINED in types:
        raise ValueError("not a BPE model with byte fallback and escaped spaces")
    own = {p: i for i, (p, t) in enumerate(zip(pieces, types)) if t in (NORMAL, UNUSED)}
    if any(SPACE in p.lstrip(SPACE) for p in own):
        raise ValueError("a piece has a space after another character")
    return PieceModel(
        pieces,
        types,
        {p: scores[i] for p, i in own.items()},
        own,
        {int(pieces[i][3:5], 16): i for i, t in enumerate(types) if t == BYTE},
        types.index(UNKNOWN),
        charsmap,
        dummy_prefix,
        trim,
        max(map(len, own), default=1),
        cutter(list(own)),
    )


def merged(model: PieceModel, text: str) -> list[str]:
    """Pieces of a normalised text: the best-scored neighbours merge first, of equal
    ones the leftmost, until no neighbours form a piece."""
    scores, parts = model.scores, list(text)
    if len(parts) < 2:
        return parts
    after = [*range(1, len(parts)), -1]
    before = [*range(-1, len(parts) - 1)]
    heap: list[tuple[float, int, str]] = []

    def offer(left: int, right: int) -> None:
        joined = parts[left] + parts[right]
        if joined in scores:
            heapq.heappush(heap, (-scores[joined], left, joined))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while heap:
        _, left, joined = heapq.heappop(heap)
        right = after[left]
        if not parts[left] or right < 0 or parts[left] + parts[right] != joined:
            continue  # one of the two has merged otherwise
        parts[left], parts[right] = joined, ""
        after[left] = after[right]
        if after[left] >= 0:
            before[after[left]] = left
            offer(left, after[left])
        if before[left] >= 0:
            offer(before[left], left)
    return [p for p in parts if p]

