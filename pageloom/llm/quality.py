"""Quality classifier: a generalised additive model with pairwise interactions.

Every whole text gives about twenty numbers: shares of byte classes, word and line
shapes, repetition. Each is cut into bins at quantiles of the training rows. Cyclic
boosting visits one feature after the other and fits a shallow tree (two splits) over
its bins to the gradients; the trees of a feature add up to one table, bin -> log odds.
Then the pairs whose joint table explains most of what is left are boosted in the same
way, by trees that split one feature and each half by the other. A score is the sum of
the looked-up values, as one vectorised addition for each table.

The model is trained on a bounded sample: ``sample_rows`` labelled ids, drawn by hash
over all that teach. Every row is scored.

Defined results: a NULL text counts as empty; an empty text is scored like any other;
without labelled rows, or with one class only, the score is the share of that class
(0.5 without any). Rows repeat as they come. NULL ids count as empty text in the fold and
teach nothing. An id that has both labels teaches nothing; of several texts under one id the
one with the smallest features teaches, so the model does not depend on the order of rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.byte_windows import text_bytes, windows
from pageloom.llm.common import fold, over_batches
from pageloom.llm.shingles import slices, word_hashes

# Byte classes whose shares are features.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "numeral": b"0123456789",
    "space": b" \t\r\v\f",
    "line": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@\\^_`{}~",
    "quote": b"'\"()[]-",
}
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)  # the rest: control and non-ASCII bytes
for _i, _chars in enumerate(_CLASSES.values()):
    _CLASS_OF[np.frombuffer(_chars, np.uint8)] = _i
_KINDS = len(_CLASSES) + 1

FEATURES = [
    *_CLASSES, "other", "log_bytes", "log_words", "word_bytes", "short_words", "long_words",
    "distinct_words", "top_word", "doubled_words", "line_words",
]


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text; long texts are read in windows."""
    data, offsets = text_bytes(texts)
    rows = len(texts)
    kinds = np.zeros((rows, _KINDS))
    for begin, end, held, cuts in windows(offsets):
        if not len(held):
            continue
        lengths = np.diff(np.append(cuts, end - begin))
        at = np.repeat(np.arange(len(held), dtype=np.int32) * _KINDS, lengths) + _CLASS_OF[data[begin:end]]
        kinds[held] += np.bincount(at, minlength=len(held) * _KINDS).reshape(-1, _KINDS)
    total = np.diff(offsets)
    words = np.zeros((rows, 7))  # number, bytes, short, long, distinct, most frequent, doubled
    row = 0
    for part in slices(texts):
        hashes, sizes, starts = word_hashes(part)
        doubled = np.concatenate([[False], hashes[1:] == hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
        for a, b in zip(starts.tolist(), starts[1:].tolist()):
            if b > a:
                counts = np.unique(hashes[a:b], return_counts=True)[1]
                own = sizes[a:b]
                words[row] = (
                    b - a, own.sum(), (own <= 3).sum(), (own > 14).sum(), len(counts), counts.max(),
                    doubled[a + 1 : b].sum(),
                )
            row += 1
    number = np.maximum(words[:, 0], 1)
    lines = kinds[:, list(_CLASSES).index("line")] + 1
    return np.column_stack(
        [
            kinds / np.maximum(total, 1)[:, None],
            np.log1p(total),
            np.log1p(words[:, 0]),
            words[:, 1:] / number[:, None],
            np.log1p(words[:, 0] / lines),
        ]
    )


@dataclass
class AdditiveModel:
    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        if not self.cuts:
            return np.zeros((len(x), 0), np.int64)
        return np.column_stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.intercept)
        for i, table in enumerate(self.tables):
            out += table[bins[:, i]]
        for i, j, table in self.pairs:
            out += table[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -35, 35)))


def _cut(grad: np.ndarray, hess: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best split of a row of bins; place 0 is no split."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    if not len(g):
        return 0.0, 0
    gg, hh = grad.sum() - g, hess.sum() - h
    gain = g * g / (h + 1) + gg * gg / (hh + 1) - grad.sum() ** 2 / (hess.sum() + 1)
    gain[(h < least) | (hh < least)] = 0
    best = int(gain.argmax())
    return (float(gain[best]), best + 1) if gain[best] > 0 else (0.0, 0)


def _tree(grad: np.ndarray, hess: np.ndarray, least: float) -> np.ndarray:
    """Leaf values of a tree with two levels of splits over the bins of one feature."""
    edges = {0, len(grad)}
    _, first = _cut(grad, hess, least)
    if first:
        edges.add(first)
        for a, b in ((0, first), (first, len(grad))):
            _, place = _cut(grad[a:b], hess[a:b], least)
            if place:
                edges.add(a + place)
    out, edges = np.zeros(len(grad)), sorted(edges)
    for a, b in zip(edges, edges[1:]):
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + 1)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, least: float) -> np.ndarray:
    """A tree that splits the rows of a joint table, then each half by its columns."""
    _, row = _cut(grad.sum(axis=1), hess.sum(axis=1), least)
    out = np.zeros_like(grad)
    for part in (slice(0, row), slice(row, None)) if row else (slice(None),):
        g, h = grad[part].sum(axis=0), hess[part].sum(axis=0)
        _, column = _cut(g, h, least)
        for side in (slice(0, column), slice(column, None)) if column else (slice(None),):
            out[part, side] = g[side].sum() / (h[side].sum() + 1)
    return out


def fit(
    x: np.ndarray,
    y: np.ndarray,
    bins: int = 32,
    rounds: int = 150,
    rate: float = 0.1,
    pairs: int = 6,
    pair_rounds: int = 60,
    least: float = 2.0,
) -> AdditiveModel:
    """Boosted tables for features ``x`` and classes ``y`` (0 or 1)."""
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return AdditiveModel(float(np.log(share / (1 - share))))
    share = y.mean()
    model = AdditiveModel(float(np.log(share / (1 - share))))
    steps = np.linspace(0, 1, bins + 1)[1:-1]
    model.cuts = [np.unique(np.quantile(x[:, i], steps)) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = model.bins(x)
    odds = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            grad, hess = slopes()
            tree = rate * _tree(
                np.bincount(at[:, i], grad, len(table)), np.bincount(at[:, i], hess, len(table)), least
            )
            table += tree
            odds += tree[at[:, i]]
    width = max(map(len, model.tables))

    def joint(i: int, j: int, weight: np.ndarray) -> np.ndarray:
        return np.bincount(at[:, i] * width + at[:, j], weight, width * width).reshape(width, width)

    grad, hess = slopes()
    gains = {}
    for i in range(x.shape[1]):
        for j in range(i):
            g, h = joint(i, j, grad), joint(i, j, hess)
            gains[i, j] = float((_pair_tree(g, h, least) * g).sum())
    model.pairs = [(i, j, np.zeros((width, width))) for i, j in sorted(gains, key=gains.get)[::-1][:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            grad, hess = slopes()
            tree = rate * _pair_tree(joint(i, j, grad), joint(i, j, hess), least)
            table += tree
            odds += tree[at[:, i], at[:, j]]
    return model


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = features(batch.column(2))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(list(found), pa.list_(pa.float64()))], names=["id", "label", "x"]
        )


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    teaches: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = 20_000,
) -> AdditiveModel:
    """Trains on a sample of labels where ``teaches`` (a condition on the id) holds."""
    label = F.col(label_col).cast("double")
    known = (
        labels.filter(teaches & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("most"))
        .filter("label = most")
        .select("id", "label", (F.xxhash64("id") / F.lit(2.0**63)).alias("drawn"))  # in -1 ... 1
    )
    number = known.count()
    # Few ids beyond those wanted pass the first test, whatever the size of the table.
    chosen = (
        known.filter(F.col("drawn") <= -1 + 4.0 * sample_rows / max(1, number))
        .orderBy("drawn", "id")
        .limit(sample_rows)
        .select("id", "label")
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most sample_rows narrow rows are broadcast; features are numbers, one row for each id.
    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")
    kind = rows.schema["id"].dataType.simpleString()
    found = over_batches(rows, _featurer, f"id {kind}, label double, x array<double>")
    found = found.groupBy("id").agg(F.min(F.struct("label", "x")).alias("row")).select("row.label", "row.x").toArrow()
    y = found.column(0).to_numpy()
    x = np.array(found.column(1).to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows come in
    return fit(x[order], y[order])


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: AdditiveModel = shared.value
        for batch in batches:
            scores = model.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"]
            )

    return score


def score_quality(
    docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id and score (0 to 1, higher: quality 1 likelier)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return over_batches(rows, _scorer(shared), f"id {kind}, score double").withColumnRenamed("id", id_col)


def quality(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3
) -> DataFrame:
    """Learns from all folds but one and scores every document: doc_id, held_out, score,
    predicted (1 from ``threshold`` on)."""
    out = fold(F.col("doc_id"), folds) == held_out
    model = fit_quality(docs, labels, ~out)
    return score_quality(docs, model).select(
        "doc_id",
        out.alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
