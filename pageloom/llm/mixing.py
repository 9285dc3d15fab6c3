"""Mixing documents to target shares of tokens by iterative proportional fitting.

Documents fall into cells: one for each combination of the named values of the target
columns, values without a target falling into ``other``. Spark sums the tokens of each
cell. Raking then scales the cells' weights to one column's target shares after the
other until all hold. The table of cells has one entry for each combination of target
values, so its size depends on the targets alone and the driver can hold it.

A document of a cell is sampled with the probability weight / largest weight, so
that no document is needed twice and the expected tokens of the sample have the target
shares. The draw is a hash of id and text: the same in every run, in every task.

Defined results: targets of a column that leave a share below 1 give the rest to
``other``; where they leave nothing, ``other`` keeps the share of tokens it has and the
targets hold among the named values, so that only a target of 0 drops a value. Values
without any tokens give their share to the others in proportion.
NULLs fall into ``other``. Documents without tokens have their cell's probability; a
cell without tokens has probability 1. Rows with one id and text share their draw. An
empty table gives no rows. Where targets contradict each other (a combination of values
that never occurs is needed) the last column's shares hold and ``raked`` tells how far
the others are off. Other columns are kept, but for those named as results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"


@dataclass(frozen=True)
class Raked:
    names: list[list[str]]  # values of each column
    probability: np.ndarray  # of each cell
    error: float  # largest distance of a share from its target


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 1000, close: float = 1e-10) -> np.ndarray:
    """Weights of the cells, so that the weighted tokens have the target shares."""
    fitted = tokens / max(tokens.sum(), 1e-300)
    for _ in range(rounds):
        off = 0.0
        for axis, target in enumerate(targets):
            others = tuple(i for i in range(tokens.ndim) if i != axis)
            held = fitted.sum(axis=others)
            off = max(off, float(np.abs(held - target).max()))
            factor = np.divide(target, held, out=np.zeros_like(target), where=held > 0)
            fitted = fitted * np.expand_dims(factor, others)
        if off < close:
            break
    return np.divide(fitted, tokens, out=np.zeros_like(fitted), where=tokens > 0)


def cell_of(column: Column, names: list[str]) -> Column:
    """The named value of a column, or ``other``."""
    return F.when(column.isin([n for n in names if n != OTHER]), column).otherwise(OTHER)


def fit_mix(docs: DataFrame, columns: dict[str, Column], tokens: Column, targets: dict[str, dict[str, float]]) -> Raked:
    names = [[*targets[c], *([OTHER] if OTHER not in targets[c] else [])] for c in targets]
    cells = docs.select(
        *[cell_of(columns[c], n).alias(f"c{i}") for i, (c, n) in enumerate(zip(targets, names))],
        tokens.cast("double").alias("tokens"),
    )
    sums = np.zeros([len(n) for n in names])
    for *cell, total in cells.groupBy(*[f"c{i}" for i in range(len(names))]).agg(F.sum("tokens")).collect():
        sums[tuple(n.index(v) for n, v in zip(names, cell))] = total or 0.0
    wanted = []
    for axis, (column, own) in enumerate(zip(targets, names)):
        share = np.array([targets[column].get(n, 0.0) for n in own])
        present = sums.sum(axis=tuple(i for i in range(sums.ndim) if i != axis))
        unnamed = OTHER not in targets[column]
        if unnamed:
            share[own.index(OTHER)] = max(0.0, 1 - share.sum())
        share[present == 0] = 0
        share /= max(share.sum(), 1e-300)
        if unnamed and sum(targets[column].values()) > 1 - 1e-9:
            rest = present[own.index(OTHER)] / max(present.sum(), 1e-300)
            share *= 1 - rest
            share[own.index(OTHER)] = rest
        wanted.append(share)
    weights = rake(sums, wanted)
    probability = np.where(sums > 0, weights / max(weights.max(), 1e-300), 1.0)
    kept = sums * probability
    error = 0.0
    for axis, share in enumerate(wanted):
        held = kept.sum(axis=tuple(i for i in range(sums.ndim) if i != axis)) / max(kept.sum(), 1e-300)
        error = max(error, float(np.abs(held - share).max()) if sums.sum() else 0.0)
    return Raked(names, probability, error)


def draw(id_: Column, text: Column, seed: int) -> Column:
    """A number in 0 ... 1 that only depends on the row and the seed."""
    return F.shiftrightunsigned(F.xxhash64(id_, text, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(
    docs: DataFrame,
    columns: dict[str, Column],
    tokens: Column,
    targets: dict[str, dict[str, float]],
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 0,
) -> DataFrame:
    """``docs`` with tokens, cell (values joined by '/'), probability and kept.

    ``targets`` maps each of ``columns`` to the wanted shares of tokens by value.
    """
    raked = fit_mix(docs, columns, tokens, targets)
    cell = F.concat_ws("/", *[cell_of(columns[c], n) for c, n in zip(targets, raked.names)])
    table = F.create_map(
        *[
            F.lit(x)
            for at in np.ndindex(*raked.probability.shape)
            for x in ("/".join(n[i] for n, i in zip(raked.names, at)), float(raked.probability[at]))
        ]
    )
    return docs.select(
        *[docs[c] for c in docs.columns if c not in ("tokens", "cell", "probability", "kept")],
        tokens.cast("long").alias("tokens"),
        cell.alias("cell"),
        F.element_at(table, cell).alias("probability"),
        (draw(F.col(id_col), F.col(text_col), seed) < F.element_at(table, cell)).alias("kept"),
    )


def word_tokens(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A rough topic by form: legal notes, contact data, tables, else prose."""
    return (
        F.when(text.contains("icense") | text.contains("opyright"), "legal")
        .when(text.contains("@"), "contact")
        .when(text.contains(" | "), "table")
        .otherwise("prose")
    )


# Shares of tokens that the mix is raked to; what they leave goes to ``other``, which keeps
# its own share where they leave nothing.
TARGETS = {
    "source": {"src0": 0.35},
    "lang": {"en": 0.60, "fr": 0.15, "de": 0.14, "es": 0.11},
    "topic": {"prose": 0.92},
}


def mix_documents(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, seed: int = 0) -> DataFrame:
    """``mix`` of documents by source, lang and topic."""
    columns = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}
    return mix(docs, columns, word_tokens(F.col("text")), targets, seed=seed)
