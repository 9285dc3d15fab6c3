"""A finite-state transducer compiled from a BPE piece model.

A state is what the coming characters can still depend on: the longest end of the text
so far that some piece begins with, and for each place in it where a later piece can
begin, the piece that ends there and how many pieces the text up to there makes,
relative to the newest count. That is bounded by the longest piece, so there are
finitely many states. A transition reads one character and carries the change in the
number of emitted tokens (a merge makes it negative). States and transitions are
compiled when first met and kept up to a bound; dropping them changes no result.

The piece that ends at a new position follows from the state: of all pieces that
end there, it is the one whose predecessor piece stays apart from it, i.e. the two
texts joined encode into just these two pieces.

No piece holds a space after another character, so a space after any other character
leads back to the start, whatever came before.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pageloom.llm.piece_model import SPACE, PieceModel, merged

@contextmanager
def few_collections() -> Iterator[None]:
    """Holds Python's cycle collector back: it would walk all states again and again.
    Reference counts free everything else; dropped states are collected at once."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class State(dict):
    """Character -> (next state, change of the count); compiled when first asked for.

    ``text`` is the end of the text that matters. ``places`` has for each place in it None
    or (piece that ends there, tokens up to there less those so far), where an empty piece
    marks the start. ``ids`` and ``size`` tell the piece that ends here.
    """

    __slots__ = ("machine", "text", "places", "ids", "size")

    def __init__(self, machine: Transducer, text: str, places: tuple):
        self.machine, self.text, self.places = machine, text, places
        piece = places[-1][0]
        self.size = max(1, len(piece))
        self.ids = (machine.model.ids[piece],) if piece else ()

    def __missing__(self, char: str) -> tuple[State, int]:
        step = self[char] = self.machine.step(self, char)
        return step


class Transducer:
    """Deterministic; the start is also the state after an unknown character."""

    def __init__(self, model: PieceModel, most_states: int = 200_000):
        self.model, self.most_states = model, most_states
        self.prefixes = {piece[:i] for piece in model.scores for i in range(len(piece))}
        self._apart: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.start = State(self, "", (("", 0),))
        self.states: dict[tuple, State] = {("", (("", 0),)): self.start}
        self.words: dict[str, tuple[State, int]] = {}

    def _stays_whole(self, piece: str) -> bool:
        if piece not in self._whole:
            self._whole[piece] = merged(self.model, piece) == [piece]
        return self._whole[piece]

    def _stay_apart(self, left: str, right: str) -> bool:
        key = (left, right)
        if key not in self._apart:
            if len(self._apart) > 2 * self.most_states:
                self._apart.clear()
            self._apart[key] = merged(self.model, left + right) == [left, right]
        return self._apart[key]

    def step(self, state: State, char: str) -> tuple[State, int]:
        """Next state and change of the count."""
        known, prefixes = self.model.scores, self.prefixes
        if char not in known:
            return self.start, len(char.encode())
        if char == SPACE and not state.text.endswith(SPACE):
            state = self.start
        text, places = state.text, state.places
        for i, place in enumerate(places):
            piece = text[i:] + char
            if place is None or piece not in known:
                continue
            left, before = place
            if self._stay_apart(left, piece) if left else self._stays_whole(piece):
                break
        else:
            raise ValueError(f"no piece ends at {char!r}")
        count, text = before + 1, text + char
        kept = [
            None if p is None or text[i:] not in prefixes else (p[0], p[1] - count)
            for i, p in enumerate(places)
        ]
        begin = next(i for i in range(len(text) + 1) if text[i:] in prefixes)
        found = (text[begin:], (*kept[begin:], (piece, 0)))
        if found not in self.states:
            self.states[found] = State(self, *found)
        return self.states[found], count

    def run(self, state: State, text: str) -> tuple[State, int]:
        """State and tokens after ``text``."""
        total = 0
        for char in text:
            state, more = state[char]
            total += more
        return state, total

    def encode(self, text: str, ids: list[int], sizes: list[int]) -> None:
        """Appends the ids of a segment and their characters. Of the bytes of an unknown
        character all but the last have none."""
        state = self.start
        path = [state := state[char][0] for char in text]
        at, found = len(text), []
        while at:  # from the end, each state tells the piece that ends there
            state = path[at - 1]
            found.append(state if state.ids else text[at - 1])
            at -= state.size
        for piece in reversed(found):
            if isinstance(piece, str):
                own = [self.model.byte_ids[b] for b in piece.encode()]
                ids += own
                sizes += [0] * (len(own) - 1) + [1]
            else:
                ids += piece.ids
                sizes.append(piece.size)

    def word(self, text: str) -> tuple[State, int]:
        found = self.words.get(text)
        if found is None:
            found = self.words[text] = self.run(self.start, text)
        return found

    def chunk(self, text: str) -> tuple[str, State | None, int]:
        """Map of a chunk: characters before the first return to the start, the state at
        its end (None without a return) and the tokens after the head."""
        head, *rest = self.model.segments.findall(text) or [""]
        if not rest:
            return head, None, 0
        total = 0
        word, words = self.word, self.words
        for segment in rest:
            found = words.get(segment) or word(segment)
            total += found[1]
        return head, found[0], total

    def compose(self, a: tuple, b: tuple) -> tuple[str, State | None, int]:
        """The map of two neighbouring chunks."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        state, more = self.run(a[1], b[0])
        return a[0], state if b[1] is None else b[1], a[2] + more + b[2]

    def tidy(self) -> None:
        """Between texts: holds the tables to their bounds."""
        if len(self.states) > self.most_states:
            self._reset()
            gc.collect()
        elif len(self.words) > self.most_states // 2:
            self.words.clear()

    def count(self, text: str, chunk_chars: int) -> int:
        """Tokens of a normalised text."""
        self.tidy()
        maps = [
            self.chunk(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)
        ] or [("", None, 0)]
        while len(maps) > 1:  # one level of the scan
            last = maps[-1:] if len(maps) % 2 else []
            maps = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)] + last
        head, _, total = maps[0]
        return self.word(head)[1] + total
