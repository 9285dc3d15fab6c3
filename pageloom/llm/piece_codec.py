"""Encoding into pieces that keep their place in the text, and decoding.

A text is normalised by the longest rule of the model's compiled character map that
fits at each place; each normalised character knows the bytes of the text it came
from. The normalised text is cut where a space follows another character, as no piece
crosses such a place, and each distinct segment is merged into pieces once while it is in
a worker's table. When that has reached about ``most_bytes``, and at the end of a task, the
segments that were met once only are dropped from it. New segments are merged one by one, or,
with ``machine``, run through the transducer of ``piece_machine``, whose states take another
200 MB of a worker but make the second task faster than the first. Each piece gets the byte span of its first to its last character; the space put before a text and pieces of
one character's bytes get the empty span at their place and that character's span.

Defined results: a NULL or empty text has no pieces and decodes to an empty text;
rows repeat as they come; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import over_batches
from pageloom.llm.packing import slices
from pageloom.llm.piece_machine import Transducer, few_collections
from pageloom.llm.piece_model import BYTE, CONTROL, SPACE, UNKNOWN, PieceModel, load, merged
from pageloom.llm.piece_normaliser import Normaliser, normaliser

class _Segments(dict):
    """Segment -> code; what the segments encode to lies in arrays that double."""

    def __init__(self, model: PieceModel, machine: Transducer | None = None):
        self.model, self.machine = model, machine
        self.pieces = np.zeros((3, 1 << 16), np.int32)  # id, begin, end (in characters)
        self.places = np.zeros((2, 1 << 14), np.int64)  # first piece, number of pieces
        self.used = self.chars = self.pending = 0
        self.met = np.zeros(0, np.int64)  # how often each segment was met
        self.noted: list[np.ndarray] = []  # codes that are not counted yet

    def _room(self, buffer: np.ndarray, more: int, used: int) -> np.ndarray:
        if used + more <= buffer.shape[1]:
            return buffer
        return np.concatenate([buffer, np.zeros_like(buffer, shape=(len(buffer), len(buffer[0]) + more))], 1)

    @property
    def size(self) -> int:
        """About the bytes held: a string, its entry and its numbers, and its characters."""
        return 250 * len(self) + 2 * self.chars + self.pieces.nbytes + self.places.nbytes

    def note(self, codes: np.ndarray) -> None:
        self.noted.append(codes)
        self.pending += len(codes)
        if self.pending > 1 << 18:
            self._count()

    def _count(self) -> None:
        counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *self.noted]), minlength=len(self))
        counts[: len(self.met)] += self.met
        self.met, self.noted, self.pending = counts, [], 0

    def shrink(self) -> None:
        """Keeps the segments met more than once since the last time."""
        self._count()
        kept = np.flatnonzero(self.met > 1)
        names = list(self)
        starts, sizes = self.places[:, kept]
        self.pieces = self.pieces[:, slices(starts, sizes)]
        self.places = np.stack([np.cumsum(sizes) - sizes, sizes])
        self.clear()
        self.update({names[i]: n for n, i in enumerate(kept)})
        self.used, self.chars = int(sizes.sum()), sum(map(len, self))
        self.met = np.zeros(len(kept), np.int64)

    def _encode(self, segment: str, ids: list[int], sizes: list[int]) -> None:
        """Appends the ids of a segment and their characters. Of the bytes of an unknown
        character all but the last have none."""
        if self.machine is not None:
            self.machine.encode(segment, ids, sizes)
            return
        known, byte_ids = self.model.ids, self.model.byte_ids
        for piece in merged(self.model, segment):
            if piece in known:
                ids.append(known[piece])
                sizes.append(len(piece))
            else:
                own = [byte_ids[b] for b in piece.encode()]
                ids += own
                sizes += [0] * (len(own) - 1) + [1]

    def add(self, segments: list[str]) -> None:
        ids: list[int] = []
        sizes: list[int] = []  # in characters
        cuts = [0]
        code = len(self)
        for segment in segments:
            self[segment] = code + len(cuts) - 1
            self._encode(segment, ids, sizes)
            cuts.append(len(ids))
        size, first = np.array(sizes, np.int64), np.array(cuts, np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        begins = ends[:-1] - np.repeat(ends[first[:-1]], np.diff(first))
        self.pieces = self._room(self.pieces, len(ids), self.used)
        # Bytes of a character lie at the place of that character.
        self.pieces[:, self.used : self.used + len(ids)] = ids, begins, begins + np.maximum(size, 1)
        sizes = np.diff(first)
        self.places = self._room(self.places, len(sizes), code)
        self.places[1, code : code + len(sizes)] = sizes
        self.places[0, code : code + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.chars += sum(map(len, segments))


class Codec:
    def __init__(self, model: PieceModel, normal: Normaliser, most_bytes: int = 80 << 20, machine: bool = False):
        self.model, self.normal, self.most_bytes = model, normal, most_bytes
        self.machine = Transducer(model) if machine else None
        self.forget()
        surfaces = []
        for i, (piece, kind) in enumerate(zip(model.pieces, model.types)):
            if kind == BYTE:
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif kind == UNKNOWN:
                surfaces.append(" ⁇ ".encode())  # fixed value: what an unknown id decodes to
            else:
                surfaces.append(b"" if kind == CONTROL else piece.replace(SPACE, " ").encode())
        self.is_byte = np.array([t == BYTE for t in model.types])
        self.surface_size = np.array([len(s) for s in surfaces], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)

    def forget(self) -> None:
        """Empties the table of segments."""
        self.segments = _Segments(self.model, self.machine)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and the begin and end byte of each piece in the text."""
        if self.machine is not None:
            self.machine.tidy()
        if self.segments.size > self.most_bytes:
            self.segments.shrink()
            if 2 * self.segments.size > self.most_bytes:
                self.forget()
        normal = self.normal
        plain = not normal.units and not normal.trim
        if plain:
            # Character i of the text is character i + 1 after the space in front.
            out = normal.text(text)
            front = len(out) - len(text)
            if text.isascii():
                edges = np.arange(len(text) + 1)
            else:
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
                edges = np.concatenate([[0], np.cumsum(widths)])
            begins = np.concatenate([np.zeros(front, np.int64), edges[:-1]])
            ends = np.concatenate([np.zeros(front, np.int64), edges[1:]])
        else:
            out, begins, ends = normal.aligned(text)
        words = self.model.segments.findall(out)
        known = self.segments
        if new := [w for w in set(words) if w not in known]:
            known.add(new)
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        known.note(codes)
        ids, first, last = known.pieces
        starts, sizes = known.places
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sizes = sizes[codes]
        at = slices(starts[codes], sizes)
        base = np.repeat(np.cumsum(lengths) - lengths, sizes)
        return ids[at], begins[base + first[at]], ends[base + last[at] - 1]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the pieces. Bytes that form no character become U+FFFD each; the
        space in front of a text is taken off."""
        if not len(ids):
            return ""
        at = slices(self.surface_start[ids], self.surface_size[ids])
        data = self.surface[at].tobytes()
        try:
            out = data.decode()
        except UnicodeDecodeError:
            out = self._decode_runs(ids)
        first = self.model.pieces[int(ids[0])]
        return out[1:] if self.model.dummy_prefix and first.startswith(SPACE) else out

    def _decode_runs(self, ids: np.ndarray) -> str:
        out: list[str] = []
        cuts = np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8))) + 1
        for run in np.split(ids, cuts):
            data = self.surface[slices(self.surface_start[run], self.surface_size[run])].tobytes()
            while data:
                try:
                    out.append(data.decode())
                    break
                except UnicodeDecodeError as error:
                    out.append(data[: error.start].decode() + "�")
                    data = data[error.start + 1 :]
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str, machine: bool = False) -> Codec:
    return Codec(load(path), normaliser(path), machine=machine)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _encoder(path: str, most_tokens: int, machine: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, machine)
        try:
            for batch in batches:
                yield from encoded(tool, batch)
        finally:
            tool.segments.shrink()

    def encoded(tool: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        begun, tokens, rows = 0, 0, []
        for i in range(batch.num_rows):
            with few_collections():
                found = tool.encode(batch.column(1)[i].as_py() or "")
            rows.append((*found, tool.decode(found[0])))
            tokens += len(found[0])
            if tokens >= most_tokens or i == batch.num_rows - 1:
                ids, begins, ends, texts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begun, len(rows)),
                        _lists(list(ids)),
                        _lists(list(begins)),
                        _lists(list(ends)),
                        pa.array(texts, pa.string()),
                    ],
                    names=["id", "ids", "begins", "ends", "decoded"],
                )
                begun, tokens, rows = i + 1, 0, []

    return encode


def encode_pieces(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_tokens: int = 500_000,
    machine: bool = False,
) -> DataFrame:
    """Of every whole text: id, ids, begins and ends (byte spans in the UTF-8 text, one
    per id) and decoded (the text the ids decode to). ``most_tokens`` only bounds the
    size of what a task hands over at once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return over_batches(
        rows,
        _encoder(model_path, most_tokens, machine),
        f"id {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string",
    ).withColumnRenamed("id", id_col)
