"""Exact top-k search by inner product: exhaustive, term at a time.

Components become integers floor(scale * x); a component is a term, its integer the
weight. Rows are packed into blocks: candidates as postings (term -> places and
weights), queries as sparse rows. Every query block meets every candidate block once:
candidate blocks lie in ``columns`` groups and query blocks in ``lines`` groups, each
pair of groups is one key of an equi-join, so work spreads over lines * columns tasks and
no task holds all of either side. In a pair of blocks each term of the queries scatters
its weighted postings into dense score arrays; a partition selection takes the k best
of each query. Tasks merge what they select in bounded memory and a window ranks the rest.

Scores are exact integers; ties go to the smaller id. Own candidates (equal id) do not
count. Vectors are wide where a product of their components could leave 64 bits; pairs with
a wide vector are searched in the same way in Python integers, and both results are ranked
together by a key that orders integers of any size.

Defined results: vectors that are NULL, hold a NULL or non-finite component, or one that is
not finite when scaled, and rows with NULL id, take no part. A score beyond 64 bits is
ranked exactly and returned as the nearest 64-bit number. Vectors of
different length are compared as if the shorter ended in zeros; an empty vector scores 0
everywhere. A candidate row that repeats takes a place each time; a query row that
repeats counts once. With fewer candidates than k all are returned. Empty tables give no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import over_batches

BLOCK = "ids binary, bounds binary, places binary, weights binary"
_BLOCK = pa.schema([(n, pa.binary()) for n in ("ids", "bounds", "places", "weights")])
_PAIRS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.binary())])
FOUND = "query_id long, vec_id long, score long, key binary"


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (whole numbers, as doubles) and wide of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * scale)
    # NULL and NaN fail the comparison as well.
    fits = F.forall(x, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fits)
    # From 2 ** 53 on doubles are whole numbers.
    whole = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    largest = F.array_max(F.transform("v", F.abs))
    return rows.withColumn("wide", F.coalesce(largest * F.sqrt(F.size("v")) >= 2.0**31, F.lit(False)))


def rank_key(number: int) -> bytes:
    """Bytes that are in order as the integers are."""
    size = (abs(number).bit_length() + 7) // 8
    body = size.to_bytes(2) + abs(number).to_bytes(size)
    return b"\1" + body if number >= 0 else b"\0" + bytes(255 - b for b in body)


def _packed(ids: np.ndarray, values: np.ndarray, lengths: np.ndarray, postings: bool) -> dict:
    """A block: non-zero weights by term for postings, else by row."""
    rows = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    starts = np.cumsum(lengths) - lengths
    terms = (np.arange(len(values)) - np.repeat(starts, lengths)).astype(np.int32)
    used = np.flatnonzero(values)
    rows, terms, values = rows[used], terms[used], values[used]
    key, place = (terms, rows) if postings else (rows, terms)
    order = np.argsort(key, kind="stable")
    size = (int(terms.max()) + 1 if len(terms) else 0) if postings else len(ids)
    bounds = np.searchsorted(key[order], np.arange(size + 1))
    return {
        "ids": ids.tobytes(),
        "bounds": bounds.astype(np.int64).tobytes(),
        "places": place[order].tobytes(),
        "weights": values[order].tobytes(),
    }


def _blocker(size: int, postings: bool, wide: bool):
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def packed() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*held)]
            return pa.RecordBatch.from_pylist([_packed(*parts, postings)], _BLOCK)

        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                lists = part.column(1)
                held.append(
                    (
                        part.column(0).to_numpy(),
                        lists.flatten().to_numpy().astype(np.float64 if wide else np.int64),
                        np.diff(lists.offsets.to_numpy()),
                    )
                )
                rows += part.num_rows
                if rows >= size:
                    yield packed()
                    held, rows = [], 0
        if rows:
            yield packed()

    return block


def _opened(row: dict, wide: bool) -> tuple[np.ndarray, ...]:
    kinds = {"ids": np.int64, "bounds": np.int64, "places": np.int32, "weights": np.float64 if wide else np.int64}
    ids, bounds, places, weights = (np.frombuffer(row[name], kind) for name, kind in kinds.items())
    if wide:  # each double is a whole number; Python's integers have no bound
        weights = np.array([int(w) for w in weights] or [0], object)[: len(weights)]
    return ids, bounds, places, weights


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, best first, ties by smaller id."""
    if scores.dtype == object:
        return np.array(heapq.nsmallest(k, range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        found = np.flatnonzero(scores >= least)
    else:
        found = np.arange(len(scores))
    return found[np.lexsort((ids[found], -scores[found]))][:k]


def _scores(queries: tuple, candidates: tuple, begin: int, end: int) -> np.ndarray:
    """Dense scores of queries begin ... end against all candidates of a block."""
    _, bounds, terms, weights = queries
    ids, posted, places, values = candidates
    scores = np.zeros((end - begin, len(ids)), weights.dtype)
    a, b = bounds[begin], bounds[end]
    rows = np.repeat(np.arange(end - begin), np.diff(bounds[begin : end + 1]))
    order = np.argsort(terms[a:b], kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(terms[a:b][order])) + 1):
        term = terms[a + own[0]] if len(own) else len(posted)
        if term + 1 >= len(posted):
            continue
        at = places[posted[term] : posted[term + 1]]
        weight = weights[a + own][:, None] * values[posted[term] : posted[term + 1]]
        if len(at) == len(ids) and len(own) == len(scores):
            scores += weight
        else:
            scores[np.ix_(rows[own], at)] += weight
    return scores


def _merged(rows: list[np.ndarray], k: int) -> np.ndarray:
    """The k best (query, candidate, score) rows of each query."""
    table = np.concatenate(rows, axis=1)
    order = np.lexsort((table[1], -table[2], table[0]))
    table = table[:, order]
    new = np.concatenate([[True], table[0][1:] != table[0][:-1]])
    rank = np.arange(table.shape[1]) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return table[:, rank < k]


def _searcher(k: int, wide: bool, lines: int = 64, most_rows: int = 500_000):
    def emit(table: np.ndarray) -> pa.RecordBatch:
        scores = [min(max(int(x), -(2**63)), 2**63 - 1) for x in table[2]]
        ids = [pa.array(c.astype(np.int64)) for c in table[:2]]
        keys = pa.array([rank_key(int(x)) for x in table[2]], pa.binary())
        return pa.RecordBatch.from_arrays([*ids, pa.array(scores, pa.int64()), keys], schema=_PAIRS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                queries, candidates = _opened(row["q"], wide), _opened(row["c"], wide)
                own, ids = queries[0], candidates[0]
                for begin in range(0, len(own), lines):
                    scores = _scores(queries, candidates, begin, min(begin + lines, len(own)))
                    for query, line in zip(own[begin : begin + lines], scores):
                        other = ids != query
                        places = best(ids, line, k) if other.all() else np.flatnonzero(other)[best(ids[other], line[other], k)]
                        held.append(np.stack([np.full(len(places), query), ids[places], line[places]]))
                        size += len(places)
                if size > most_rows or wide and held:
                    held = [np.concatenate(held, axis=1) if wide else _merged(held, k)]
                    size = held[0].shape[1]
                    if size > most_rows // 2 or wide:
                        yield emit(held[0])
                        held, size = [], 0
        if size:
            yield emit(_merged(held, k))

    return search


def _searched(
    rows: DataFrame, asked: DataFrame, sizes: tuple[int, int], wide: bool, k: int, candidate_block: int, query_block: int
) -> DataFrame:
    """The k best candidates of each query in every pair of blocks, at least."""
    candidates, queries = sizes
    lines = max(1, math.ceil(queries / (16 * query_block)))
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    columns = max(2 * parallel, math.ceil(candidates / (16 * candidate_block)))
    block = F.struct("ids", "bounds", "places", "weights")

    def dealt(side: DataFrame, number: int, size: int, postings: bool, own: str, groups: int, other: str, others: int):
        """Blocks in groups of equal size, once for each group of the other side."""
        even = side.select("id", "v").repartition(max(1, math.ceil(number / size)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        return (
            over_batches(even, _blocker(size, postings, wide), BLOCK)
            .select(
                F.pmod(F.spark_partition_id().cast("long"), F.lit(groups).cast("long")).alias(own),
                every.alias(other),
                block.alias("c" if postings else "q"),
            )
            .repartition(4 * lines * columns, "line", "column")  # few keys: more places than keys
        )

    right = dealt(rows, candidates, candidate_block, True, "column", columns, "line", lines)
    left = dealt(asked, queries, query_block, False, "line", lines, "column", columns)
    pairs = left.join(right, ["line", "column"]).select("q", "c")
    return over_batches(pairs, _searcher(k, wide), FOUND)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    candidate_block: int = 4096,
    query_block: int = 1024,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best candidates of every row for
    which ``is_query`` (a condition on the id column) holds."""
    rows = scaled(vectors, id_col, vector_col, scale)
    asked = scaled(vectors.filter(is_query), id_col, vector_col, scale).dropDuplicates(["id", "v"])

    def number(side: DataFrame) -> tuple[int, int]:
        """Narrow and wide rows."""
        found = side.agg(F.count_if(~F.col("wide")), F.count_if("wide")).first()
        return found[0], found[1]

    held, wide_held = number(rows)
    queries, wide_queries = number(asked)
    narrow_rows, narrow_asked = rows.filter("not wide"), asked.filter("not wide")
    size = (k, candidate_block, query_block)
    found = _searched(narrow_rows, narrow_asked, (held, queries), False, *size)
    if wide_held:
        sizes = (wide_held, queries + wide_queries)
        found = found.unionByName(_searched(rows.filter("wide"), asked, sizes, True, *size))
    if wide_queries:
        of_wide = _searched(narrow_rows, asked.filter("wide"), (held, wide_queries), True, *size)
        found = found.unionByName(of_wide)
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
