"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are its byte n-grams of two to four bytes that lie within a word and
its borders, lower-cased, with everything but letters as a border, hashed into
``2 ** bits`` buckets. The embeddings of all n-grams of the whole text are averaged
and a linear layer gives one score per language. As both steps are linear, a trained
model is one table, bucket -> score per language, which is summed over the text.

Training is stochastic gradient descent in NumPy on a bounded sample: at most
``rows_per_label`` rows for each of the ``most_labels`` most frequent labels (further labels
are never predicted), drawn by a hash of id and text over all labelled rows, and of these, in
the order of the draw, as many as have ``most_entries`` buckets together. Every fifth sampled row is left out of it and calibrates: a
temperature for the scores, and the least familiarity of an accepted text.

The score tells languages apart that training has seen, it does not tell that a text is
in none of them. Familiarity does: the mean, over the n-grams of a text, of the log
frequency of their bucket in the label where it is highest, as a difference from what
is usual for calibration rows. It is one more column of the table. ``_USUAL`` n-grams of
usual familiarity are added, so that a text of a few letters is not judged by them. The
n-grams of an unlearned script hash into any bucket; the limit rejects all but
``noise_share`` of words of such noise, unless that were more than ``reject_share`` of
the calibration rows and short pieces of them, which then sets it.

Defined results: a NULL text or one without any letter is ``und`` with score 0 and is
not accepted; without labelled rows all texts are; with a single label all others have
it with score 1, and are accepted if familiar. NULL labels teach nothing. NULL ids count as
empty text in the fold. Rows with the same id, text and label teach once; an id with several
labels or texts teaches each of them.
Equal texts get equal results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.byte_windows import text_bytes, windows
from pageloom.llm.common import fold, over_batches, ship
from pageloom.llm.packing import pack, unpack

_SIZES = (2, 3, 4)
_BORDER = 32
_USUAL = 4
# Bytes of words stay (ASCII letters and all of other alphabets), the rest is a border.
_WORD = np.full(256, _BORDER, np.uint8)
_WORD[97:123] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class LanguageModel:
    labels: list[str]
    # (buckets + 1, labels + 1): scores, then familiarity; the last row, for what is no
    # n-gram, is zero.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float  # of familiarity
    bits: int


def _grams(data: np.ndarray, begin: int, end: int, ends: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For each n-gram size the bucket at every place of a window; 2 ** bits where there
    is none. ``ends`` are the ends of the texts, relative to the window."""
    part = np.zeros(end - begin + 3, np.uint32)
    have = data[begin : end + 3]
    part[: len(have)] = have
    size = end - begin
    border = part == _BORDER
    value = part[:size].copy()
    for n in range(2, _SIZES[-1] + 1):
        value |= part[n - 1 : size + n - 1] << np.uint32(8 * (n - 1))
        inner = np.zeros(size, bool)
        if n == 2:
            inner |= border[:size] & border[1 : size + 1]
        for i in range(1, n - 1):
            inner |= border[i : size + i]
        for i in range(1, n):
            last = ends - i
            inner[last[(last >= 0) & (last < size)]] = True
        hashed = (value * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        hashed = (hashed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
        hashed[inner] = 1 << bits
        yield hashed


def _prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(pc.utf8_lower(texts))
    return _WORD[data], offsets


def _counter(bits: int):
    """Buckets and counts of each text, for training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, offsets = _prepared(batch.column(1).slice(i, 1))
                total = np.zeros((1 << bits) + 1, np.int64)
                for begin, end, _, _ in windows(offsets):
                    for hashed in _grams(data, begin, end, offsets[1:] - begin, bits):
                        total += np.bincount(hashed, minlength=len(total))
                found = np.flatnonzero(total[:-1])
                packed = [pa.array([pack(x)], pa.binary()) for x in (found, total[found])]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(i, 1) for c in batch.columns[:1] + batch.columns[2:]], *packed],
                    names=["label", "place", "drawn", "buckets", "counts"],
                )

    return count


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _descend(rows, labels: int, bits: int, size: int, epochs: int, rate: float):
    """Embeddings, weights and bias by stochastic gradient descent, in a fixed order."""
    draw = np.random.default_rng(7)
    embedding = draw.uniform(-1 / size, 1 / size, (1 << bits, size))
    weights, bias = draw.uniform(-1 / size, 1 / size, (labels, size)), np.zeros(labels)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            buckets, shares, label = rows[i]
            step = rate * (1 - done / steps)
            mean = shares @ embedding[buckets]
            error = _softmax(weights @ mean + bias)
            error[label] -= 1
            embedding[buckets] -= step * np.outer(shares, error @ weights)
            weights -= step * np.outer(error, mean)
            bias -= 0.1 * step * error
            done += 1
    return embedding, weights, bias


def _familiarity(taught, labels: int, bits: int, unseen: float = 0.01) -> np.ndarray:
    """Log frequency of each bucket in the label where it is highest; a text counts as one."""
    frequency = np.zeros((labels, 1 << bits), np.float32)
    for buckets, shares, label in taught:
        frequency[label, buckets] += shares
    frequency /= np.maximum(frequency.sum(axis=1, keepdims=True), 1e-30)
    return np.log((1 - unseen) * frequency.max(axis=0) + unseen / (1 << bits)).astype(np.float64)


def _least_familiar(
    known: np.ndarray, held, sizes: np.ndarray, reject_share: float, noise_share: float
) -> float:
    """The limit between unlearned texts and calibration rows, whole and in short pieces."""
    draw = np.random.default_rng(5)
    clean = [n / (n + _USUAL) * (shares @ known[buckets]) for (buckets, shares, _), n in zip(held, sizes)]
    for buckets, shares, _ in held:
        ends = np.cumsum(shares)
        for n in (1, 4, 16):
            at = np.minimum(np.searchsorted(ends, draw.random(n), "right"), len(buckets) - 1)
            clean.append(known[buckets[at]].sum() / (n + _USUAL))
    noise = known[draw.integers(0, len(known), (2_000, 16))].sum(axis=1) / (16 + _USUAL)
    return min(float(np.quantile(clean, reject_share, method="lower")), float(np.quantile(noise, 1 - noise_share)))


def train(
    rows: list[tuple[str, np.ndarray, np.ndarray]],
    bits: int = 15,
    size: int = 16,
    epochs: int = 8,
    rate: float = 4.0,
    reject_share: float = 0.001,
    noise_share: float = 0.01,
) -> LanguageModel | None:
    """A model of (label, buckets, counts) rows; None without rows."""
    rows = [r for r in rows if len(r[1])]
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    ready = [(b, c / c.sum(), labels.index(label)) for label, b, c in rows]
    taught = [r for i, r in enumerate(ready) if i % 5 or len(ready) < 50]
    held = [r for i, r in enumerate(ready) if not i % 5]
    sizes = np.array([c.sum() for i, (_, _, c) in enumerate(rows) if not i % 5])
    embedding, weights, bias = _descend(taught, len(labels), bits, size, epochs, rate)
    table = np.zeros(((1 << bits) + 1, len(labels) + 1), np.float32)
    table[:-1, :-1] = embedding @ weights.T
    known = _familiarity(taught, len(labels), bits)
    known -= np.mean([shares @ known[buckets] for buckets, shares, _ in held])
    table[:-1, -1] = known
    scores = np.array([shares @ table[buckets, :-1] + bias for buckets, shares, _ in held])
    right = np.array([label for *_, label in held])
    losses = {
        t: -np.log(_softmax(scores / t)[np.arange(len(right)), right] + 1e-12).mean()
        for t in np.geomspace(0.05, 5, 60)
    }
    temperature = float(min(losses, key=losses.get))
    threshold = _least_familiar(known, held, sizes, reject_share, noise_share)
    return LanguageModel(labels, table, bias, temperature, threshold, bits)


def _scorer(shared):
    def score(texts: pa.Array) -> pa.Array:
        model: LanguageModel = shared.value
        data, offsets = _prepared(texts)
        total = np.zeros((len(texts), len(model.labels) + 1))
        grams = np.zeros(len(texts), np.int64)
        for begin, end, held, cuts in windows(offsets, 1 << 18):
            for hashed in _grams(data, begin, end, offsets[held + 1] - begin, model.bits):
                total[held] += np.add.reduceat(model.table[hashed], cuts, axis=0)
                grams[held] += np.add.reduceat((hashed < 1 << model.bits).astype(np.int64), cuts)
        mean = total[:, :-1] / np.maximum(grams, 1)[:, None] + model.bias
        share = _softmax(mean / model.temperature)
        return pa.StructArray.from_arrays(
            [
                pa.array([model.labels[i] for i in share.argmax(axis=1)], pa.string()),
                pa.array(share.max(axis=1), pa.float64()),
                pa.array(total[:, -1] / (grams + _USUAL) >= model.threshold, pa.bool_()),
            ],
            names=["lang", "score", "familiar"],
        )

    return score


def fit_language(
    docs: DataFrame,
    teaches: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    rows_per_label: int = 1_000,
    most_labels: int = 200,
    bits: int = 15,
    most_entries: int = 1 << 23,
) -> LanguageModel | None:
    """Trains on rows where ``teaches`` holds and the label is not NULL."""
    known = docs.filter(teaches & F.col(label_col).isNotNull()).select(
        F.col(label_col).alias("label"),
        F.col(text_col).alias("text"),
        (F.xxhash64(id_col, F.xxhash64(text_col)) / F.lit(2.0**63)).alias("drawn"),  # in -1 ... 1
    )
    rows = known.select("label", "drawn")
    sizes = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_labels).collect()
    if not sizes:
        return None
    # Few rows beyond those wanted pass the first test, whatever the size of the table.
    share = F.create_map(*[x for r in sizes for x in (F.lit(r[0]), F.lit(-1 + 4.0 * rows_per_label / r[1]))])
    order = Window.partitionBy("label").orderBy("drawn")
    chosen = (
        rows.filter(F.col("drawn") <= share[F.col("label")])
        .distinct()
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= rows_per_label)
    )
    # At most rows_per_label * most_labels narrow rows are broadcast.
    texts = known.join(F.broadcast(chosen), ["label", "drawn"]).select("label", "text", "place", "drawn")
    schema = "label string, place int, drawn double, buckets binary, counts binary"
    counted = over_batches(texts, _counter(bits), schema).dropDuplicates(["label", "drawn"])
    found, entries = [], 0
    for r in counted.orderBy("place", "label").toLocalIterator():
        row = (r["label"], unpack(r["buckets"]).astype(np.int32), unpack(r["counts"]).astype(np.int32))
        entries += len(row[1])
        if entries > most_entries:
            break
        found.append(row)
    found.sort(key=lambda r: (r[0], len(r[1]), int(r[2].sum()), r[1].tobytes()))
    order = np.random.default_rng(3).permutation(len(found))
    return train([found[i] for i in order], bits)


def identify_language(
    docs: DataFrame,
    model: LanguageModel | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per document: id, or the columns ``keep``, and lang_pred, score (0 to 1) and
    accepted."""
    keep = keep or [id_col]
    ship(docs.sparkSession)
    # The text alone goes to Python, and only what is found comes back.
    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text_col].alias("text"))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        nothing = (F.lit(None).cast("string"), F.lit(0.0), F.lit(False))
        found = F.struct(*[x.alias(n) for x, n in zip(nothing, ("lang", "score", "familiar"))])
        letters = F.lit(False)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        score = F.arrow_udf(_scorer(shared), "struct<lang: string, score: double, familiar: boolean>")
        found = score("text")
    rows = rows.select("*", found.alias("found"), letters.alias("letters"))
    return rows.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.when(F.col("letters"), F.col("found.lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("found.score")).otherwise(0.0).alias("score"),
        (F.col("letters") & F.col("found.familiar")).alias("accepted"),
    )


def language_id(docs: DataFrame, folds: int = 3, held_out: int = 1, **options) -> DataFrame:
    """Learns from all folds but one and identifies every document: doc_id, held_out,
    lang_pred, score, accepted."""
    out = fold(F.col("doc_id"), folds) == held_out
    model = fit_language(docs, ~out, **options)
    found = identify_language(docs, model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "accepted")
