"""Alignment of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library and reads a space and the text,
B a SentencePiece BPE model that adds this space itself. Of each text the tokens, by the
bytes they cover, make two incidence matrices; their product A * B^T holds the pairs of tokens
that share bytes, and those whose bytes end together are links. Places where tokens of both end
cut a text into groups (``incidence``).

Texts are cut where a visible Latin character is followed by one space and another such
character. No token of either tokenizer crosses such a place: A splits there before it
merges, and no piece of B has a space after another character. So a segment is encoded and
aligned once while it is in a task's table, which goes with the task. When that has reached
about ``most_bytes``, the segments that were met once only are dropped from it.

Links of ids over the corpus: where tokens end together one's bytes are an end of the
other's. So all pairs of ids that can ever be linked follow from the two vocabularies, a
few hundred thousand; a link is kept as its number in that list (``Vocabularies``), and the
counts of the whole corpus are one number for each, which is the proven bound of what is
gathered and broadcast.

Defined results: a text that is NULL or empty, or whose tokens' bytes joined differ from the
space and the text, has no tokens: all numbers are 0 and ``groups`` is ''. Strings of special
tokens are plain text. Rows that repeat count each time; ids may be NULL or repeat; other
columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import over_batches, saved
from pageloom.llm.incidence import align
from pageloom.llm.packing import slices
from pageloom.llm.piece_model import BYTE, CONTROL, SPACE, UNKNOWN, load

# Visible characters up to U+024F: no version of Unicode takes one for white space.
_CUT = re.compile("(?<=[!-~¡-ɏ])(?= [!-~¡-ɏ])")
_WHOLE = re.compile("(?s) [!-~¡-ɏ](?:[^▁]*[!-~¡-ɏ])?")  # segments that may be joined again
_SUM_COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_group_pairs")


def byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: visible bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabularies:
    """Bytes of all tokens, and the pairs of ids that can be linked."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_letters()
        entries = {i: bytes(letters[c] for c in t) for t, i in data["model"]["vocab"].items()}
        entries |= {t["id"]: t["content"].encode() for t in data["added_tokens"]}
        self.a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        model = load(b_path)
        self.b = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(SPACE, " ").encode()
            for p, k in zip(model.pieces, model.types)
        ]
        ids_a, ids_b = defaultdict(list), defaultdict(list)
        for ids, tokens in ((ids_a, self.a), (ids_b, self.b)):
            for i, token in enumerate(tokens):
                if token:
                    ids[token].append(i)
        n = len(self.b)
        keys = [a * n + b for a, t in enumerate(self.a) for i in range(len(t)) for b in ids_b.get(t[i:], ())]
        keys += [a * n + b for b, t in enumerate(self.b) for i in range(len(t)) for a in ids_a.get(t[i:], ())]
        self._keys = np.unique(np.array(keys, np.int64))
        self.pair_a, self.pair_b = np.divmod(self._keys, n)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self._keys, a * len(self.b) + b).astype(np.int32)

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Whether a pair's count is the highest of its B id."""
        most = np.zeros(len(self.b), np.int64)
        np.maximum.at(most, self.pair_b, counts)
        return counts == most[self.pair_b]


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


class _Surfaces:
    """Bytes of sequences of ids."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.names = [f"{i}{end}" for i in range(len(tokens)) for end in (",", "|", ";", "")]

    def shares(self, ids: np.ndarray, numbers: np.ndarray, runs: list[list[str]], data: list[bytes]) -> np.ndarray:
        """How many ids each segment of the runs has, by its bytes; a segment that is a run
        of its own has all of them, whatever their bytes."""
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        own = np.fromiter(map(len, data), np.int64, len(data))
        ends = np.cumsum(self.sizes[ids])
        before = np.concatenate([[0], ends])[np.cumsum(numbers) - numbers]  # bytes before each run
        starts = np.cumsum(lengths) - lengths
        inside = np.cumsum(own) - np.repeat((np.cumsum(own) - own)[starts], lengths)
        last = np.searchsorted(ends, np.repeat(before, lengths) + inside, "right")
        last[starts + lengths - 1] = np.cumsum(numbers)
        return np.diff(last, prepend=0)

    def spell(self, ids: np.ndarray, numbers: np.ndarray, data: list[bytes]) -> np.ndarray:
        """Whether the bytes of each sequence, ``numbers`` ids long, are those of ``data``."""
        joined = self.data[slices(self.starts[ids], self.sizes[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.cumsum(numbers)].tolist()
        return np.array([joined[a:b] == d for a, b, d in zip([0, *ends[:-1]], ends, data)], bool)


def _joined(segments: list[str], most: int = 64) -> list[list[str]]:
    """Segments in runs that are encoded as one text, as tokens end where they do."""
    runs: list[list[str]] = []
    is_open = False
    for segment in segments:
        whole = _WHOLE.fullmatch(segment) is not None
        if is_open and whole and len(runs[-1]) < most:
            runs[-1].append(segment)
        else:
            runs.append([segment])
        is_open = whole
    return runs


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and how many each list has."""
    numbers = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(numbers.sum())), numbers


class Aligner:
    """Encodes and aligns segments; new ones together, known ones by a table."""

    def __init__(self, a_path: str, b_path: str, most_bytes: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers  # reads the setting above

        self.words = vocabularies(a_path, b_path)
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.of_a, self.of_b = _Surfaces(self.words.a), _Surfaces(self.words.b)
        self.most_bytes = most_bytes
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.chars = 0
        self.texts: list[str] = []  # groups of each segment
        self.sums = np.zeros((0, len(_SUM_COLUMNS)), np.int32)
        self.right = np.zeros(0, bool)
        self.links = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int32)  # how often each segment was met

    def _tidy(self) -> None:
        """Keeps the segments met more than once, unless those are too many as well."""
        # A string and its groups, their entries, and their numbers.
        if 400 * len(self.codes) + 8 * self.chars + 4 * len(self.links) <= self.most_bytes:
            return
        kept = np.flatnonzero(self.met > 1)
        if 2 * len(kept) > len(self.codes):
            self._reset()
            return
        sizes = self.sums[kept, 3].astype(np.int64)
        self.links = self.links[slices(self.starts[kept], sizes)]
        self.starts = np.cumsum(sizes) - sizes
        self.sums, self.right = self.sums[kept], self.right[kept]
        self.texts = [self.texts[i] for i in kept]
        names = list(self.codes)
        self.codes = {names[i]: n for n, i in enumerate(kept)}
        self.chars = sum(map(len, self.codes))
        self.met = np.zeros(len(kept), np.int32)

    def learn(self, segments: list[str]) -> None:
        """Takes new segments into the table; each begins with a space."""
        data = [s.encode() for s in segments]
        runs = _joined(segments)
        texts = ["".join(run) for run in runs]
        found_a, n_a = _flat([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        found_b, n_b = _flat(self.b.encode([t[1:] for t in texts], num_threads=1))
        n_a, n_b = self.of_a.shares(found_a, n_a, runs, data), self.of_b.shares(found_b, n_b, runs, data)
        right = self.of_a.spell(found_a, n_a, data) & self.of_b.spell(found_b, n_b, data)
        a, b = found_a[np.repeat(right, n_a)], found_b[np.repeat(right, n_b)]
        n_a, n_b = np.where(right, n_a, 0), np.where(right, n_b, 0)
        aligned = align(self.of_a.sizes[a], self.of_b.sizes[b])
        own = np.repeat(np.arange(len(segments)), n_a)  # segment of each A token
        per = lambda at, weights=None: np.bincount(at, weights, len(segments)).astype(np.int64)
        linked = own[aligned.link_a]
        # Groups end where segments do, so the last token of each group tells its segment.
        last = np.flatnonzero(np.diff(aligned.group_a, append=-1))
        overlaps = n_a + n_b - per(own[last])  # tokens of a group overlap in a chain
        columns = [n_a, n_b, per(own[last]), per(linked), overlaps, per(own[last], aligned.group_sizes)]
        assert int(overlaps.sum()) == aligned.overlaps
        self.sums = np.concatenate([self.sums, np.stack(columns, 1).astype(np.int32)])
        self.met = np.concatenate([self.met, np.zeros(len(segments), np.int32)])
        self.right = np.concatenate([self.right, right])
        sizes = per(linked)
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(sizes) - sizes])
        self.links = np.concatenate([self.links, self.words.numbers(a[aligned.link_a], b[aligned.link_b])])
        self.texts += self._texts(a, b, aligned, n_a, n_b)
        self.codes.update(zip(segments, range(len(self.codes), len(self.codes) + len(segments))))
        self.chars += sum(map(len, segments))

    def _texts(self, a: np.ndarray, b: np.ndarray, aligned, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """Groups of each segment, as ids of A, a bar, and ids of B; groups by semicolons."""
        key = np.concatenate([2 * aligned.group_a, 2 * aligned.group_b + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        step = np.diff(key, append=-1)
        mark = np.where(step == 0, 0, np.where(key % 2 == 0, 1, 2))  # , | ;
        ends = np.cumsum(n_a + n_b)
        mark[ends[n_a > 0] - 1] = 3
        name = 4 * np.concatenate([a, b])[order] + mark
        parts = [
            (self.of_a if side == 0 else self.of_b).names[i] for side, i in zip((key % 2).tolist(), name.tolist())
        ]
        return ["".join(parts[begin:end]) for begin, end in zip([0, *ends[:-1]], ends)]

    def rows(self, texts: list[str]) -> list[tuple[np.ndarray, str, np.ndarray]]:
        """Sums, groups and links of each text."""
        self._tidy()
        cut = [_CUT.split(" " + t) if t else [] for t in texts]
        if new := [s for s in dict.fromkeys(s for segments in cut for s in segments) if s not in self.codes]:
            self.learn(new)
        out, met = [], []
        for segments in cut:
            at = np.fromiter(map(self.codes.__getitem__, segments), np.int64, len(segments))
            met.append(at)
            if not len(at) or not self.right[at].all():
                at = at[:0]
            sums = self.sums[at].astype(np.int64)
            links = self.links[slices(self.starts[at], sums[:, 3])]
            out.append((sums.sum(axis=0), ";".join([self.texts[i] for i in at.tolist()]), links))
        self.met += np.bincount(np.concatenate(met), minlength=len(self.met)).astype(np.int32)
        return out


def _release() -> None:
    """Gives back to the system what a task has held; its worker lives on beside others."""
    vocabularies.cache_clear()
    load.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _aligned(a_path: str, b_path: str, part_chars: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from aligned(batches)
        finally:
            _release()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = None
        for batch in batches:
            tool = tool or Aligner(a_path, b_path)
            texts, begin = batch.column(1), 0
            while begin < batch.num_rows:
                part: list[str] = []
                chars = 0
                while begin + len(part) < batch.num_rows and (not part or chars < part_chars):
                    part.append(texts[begin + len(part)].as_py() or "")
                    chars += len(part[-1])
                sums, groups, links = zip(*tool.rows(part))
                offsets = np.cumsum([0, *map(len, links)]).astype(np.int32)
                values = pa.array(np.concatenate(links).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(part)),
                        *[pa.array(c) for c in np.array(sums).T],
                        pa.array(groups, pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets), values),
                    ],
                    names=["id", *_SUM_COLUMNS, "groups", "links"],
                )
                begin += len(part)

    return step


def align_tokens(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_chars: int = 1 << 19,
) -> DataFrame:
    """Of every whole text: id; n_a and n_b (tokens), n_groups, n_links, n_overlaps (pairs that
    share bytes), n_group_pairs (pairs in one group); groups, as ``a1,a2|b1;a3|b2,b3``; and
    links, as numbers in ``Vocabularies``' list of pairs. Texts are handled about
    ``part_chars`` characters at a time."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _SUM_COLUMNS)
    schema = f"id {kind}, {counts}, groups string, links array<int>"
    return over_batches(rows, _aligned(a_path, b_path, part_chars), schema).withColumnRenamed("id", id_col)


def link_counts(aligned: DataFrame, words: Vocabularies) -> np.ndarray:
    """How many links of the corpus hold each pair of the list."""
    found = aligned.select(F.explode("links").alias("pair")).groupBy("pair").count()
    counts = np.zeros(len(words.pair_a), np.int64)
    for row in found.toLocalIterator():  # one row for each pair of the vocabularies at most
        counts[row["pair"]] = row["count"]
    return counts


def _scorer(shared):
    def score(links: pa.Array) -> pa.Array:
        counts, best = shared.value
        at = links.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.diff(links.offsets.to_numpy()))])
        sums = [np.concatenate([[0], np.cumsum(x[at].astype(np.int64))]) for x in (best, counts)]
        columns = [pa.array(x[ends[1:]] - x[ends[:-1]]) for x in sums]
        return pa.StructArray.from_arrays(columns, names=["n_best", "count_sum"])

    return score


def token_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: the columns of ``align_tokens`` but links, ``groups`` as its SHA-256 ('' without
    tokens); n_best (links whose count over the corpus is their B id's highest) and count_sum."""
    found = align_tokens(docs, a_path, b_path, id_col, **options)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    found = saved(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    words = vocabularies(a_path, b_path)
    counts = link_counts(found, words)
    shared = docs.sparkSession.sparkContext.broadcast((counts, words.best(counts)))
    score = F.arrow_udf(_scorer(shared), "struct<n_best: bigint, count_sum: bigint>")
    scored = found.withColumn("_scores", score("links"))
    return scored.select(*[c for c in found.columns if c != "links"], "_scores.n_best", "_scores.count_sum")
