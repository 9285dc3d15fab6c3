"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

1. Each text becomes its set of word shingles and a signature of ``coordinates``
   minima. Texts with the same set are one node, whatever their number.
2. A node is posted under each (coordinate, value) pair. Values that one node has alone
   can match nothing and are skipped. Two nodes with ``matches`` equal coordinates
   share one of their ``coordinates - matches + 1`` rarest, so only this prefix of a
   node's list, in order of frequency, is joined; frequent values of common passages
   fall behind it.
3. Within a posting list every node meets one member drawn by hash, another in each
   list, so a list of m nodes makes m - 1 pairs. Pairs whose signatures agree in
   ``matches`` coordinates are confirmed on the full shingle sets of both texts, first
   the best pair of each node, then those that still join different components.
4. What is left: nodes of a list outside its largest component meet all nodes of other
   components in it. Pairs within a component need no test, so near copies of one text
   are never all paired, while no link between components is missed. A shingle that no
   other node of such lists holds cannot be shared; counting those bounds the similarity
   of a pair from above, so texts changed too much to reach the limit meet none. The
   others are compared by a signature of ``bits`` one-bit minima before their texts are.

With similarity s a pair's matches follow a binomial distribution with mean
``coordinates * s``: at 48 coordinates, 27 matches and s = 0.8 about 4 of 100,000 pairs
fall short; higher similarities are safer still. Sets of few shingles do a little worse, as
the hash functions are linear: 3 of 16,000 pairs of 5 and 10 shingles. Of the bits (1 + s) / 2 agree; those of a
pair may fall 4.5 standard deviations short.

Defined results: NULL and empty texts, and texts without words, have no shingles and no
links. Rows with one id count as one document. A row with NULL id belongs to its equal
sets and else stands alone with component NULL; it is kept. An empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import over_batches
from pageloom.llm.components import components
from pageloom.llm.shingles import mixed, shingle_sets
from pageloom.session import work_dir, written


def coefficients(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the hash functions, the same in every run."""
    base = mixed(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:coordinates] | np.uint64(1), base[coordinates:]


def signature(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over a set, in steps that bound the memory."""
    least = np.full(len(factors), 0xFFFFFFFF, np.uint64)
    step = max(1, (1 << 18) // len(factors))
    for i in range(0, len(hashes), step):
        part = hashes[None, i : i + step] * factors[:, None] + offsets[:, None]
        np.minimum(least, (part >> np.uint64(32)).min(axis=1), out=least)
    return least.astype(np.uint32).view(np.int32)


def _sketcher(words: int, coordinates: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = coefficients(coordinates)
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for hashes in shingle_sets(batch.column(1), words):
                sizes.append(len(hashes))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                signatures.append(signature(hashes, factors, offsets))
            flat = np.concatenate(signatures) if signatures else np.zeros(0, np.int32)
            bounds = np.arange(len(sizes) + 1, dtype=np.int32) * coordinates
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                ],
                names=["id", "n", "same", "sig"],
            )

    return sketch


def _confirmer(words: int, num: int, den: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            # Texts that repeat within a batch, as those of hubs do, are read once.
            coded = batch.column(3).dictionary_encode()
            right = list(shingle_sets(coded.dictionary, words))
            for i, left in enumerate(shingle_sets(batch.column(1), words)):
                other = right[coded.indices[i].as_py()]
                both = np.intersect1d(left, other, assume_unique=True).size
                linked[i] = both > 0 and den * both >= num * (left.size + other.size - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2)], names=["u", "v"]
            ).filter(pa.array(linked))

    return confirm


def _agreeing(left: Column, right: Column) -> Column:
    """Number of equal coordinates of two signatures."""
    same = F.zip_with(left, right, lambda a, b: (a == b).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def _bit_sketcher(words: int, bits: int):
    """(node, bits): the lowest bits of ``bits`` minima, packed into 64-bit numbers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = coefficients(bits)
        for batch in batches:
            packed = [
                np.packbits(signature(hashes, factors, offsets) & 1).view(np.int64)
                for hashes in shingle_sets(batch.column(1), words)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.list_(pa.int64()))], names=["node", "bits"]
            )

    return sketch


def _shingler(words: int):
    """(node, hash) of every shingle."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, hashes in enumerate(shingle_sets(batch.column(1), words)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hashes), batch.column(0)[i].as_py(), np.int64)), pa.array(hashes.view(np.int64))],
                    names=["node", "hash"],
                )

    return explode


class _Search:
    """One run; keeps the parameters and the work folder."""

    def __init__(self, docs, id_col, text_col, words, num, den, coordinates, matches, bits):
        self.texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.words, self.num, self.den = words, num, den
        self.coordinates, self.matches, self.bits = coordinates, matches, bits
        self.folder = work_dir(docs.sparkSession)
        self.steps = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.steps += 1
        return written(df, f"{self.folder}/{self.steps}")

    def sketches(self) -> DataFrame:
        return self.keep(
            over_batches(
                self.texts,
                _sketcher(self.words, self.coordinates), "id long, n long, same binary, sig array<int>"
            )
        )

    def near(self, n: str, m: str) -> Column:
        """Sizes at which the similarity can be reached at all."""
        return self.den * F.least(n, m) >= self.num * F.greatest(n, m)

    def postings(self, nodes: DataFrame) -> DataFrame:
        """(value, node, n, sig) of each node's prefix, without values of one node."""
        posted = nodes.select("node", F.posexplode("sig").alias("i", "least")).select(
            "node",
            F.shiftleft(F.col("i").cast("long"), 32)
            .bitwiseOR(F.col("least").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
            .alias("value"),
        )
        shared = posted.groupBy("value").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
        prefix = self.coordinates - self.matches + 1
        lists = (
            posted.join(shared, "value")
            .groupBy("node")
            .agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("values"))
        )
        # Values of one node come first in order of frequency and use up the prefix.
        left = prefix - self.coordinates + F.size("values")
        lists = lists.filter(left > 0).select(
            "node", F.explode(F.slice("values", 1, F.greatest(left, F.lit(1)))).alias("held")
        )
        lists = lists.select("node", F.col("held.value").alias("value"))
        return self.keep(lists.join(nodes, "node"))

    def met(self, postings: DataFrame) -> DataFrame:
        """(u, v, agree): each node with the drawn member of each of its lists."""
        drawn = (
            postings.groupBy("value")
            .agg(F.min(F.struct(F.xxhash64("node", "value"), "node")).alias("drawn"), F.count(F.lit(1)).alias("held"))
            .filter("held > 1")
            .select("value", F.col("drawn.node").alias("node"))
        )
        drawn = postings.join(drawn, ["value", "node"]).select(
            "value", F.col("node").alias("v"), F.col("n").alias("m"), F.col("sig").alias("other")
        )
        pairs = postings.join(drawn, "value").filter((F.col("node") != F.col("v")) & self.near("n", "m"))
        pairs = pairs.select(F.col("node").alias("u"), "v", _agreeing(F.col("sig"), F.col("other")).alias("agree"))
        return self.keep(pairs.filter(F.col("agree") >= self.matches).distinct())

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose full sets are similar enough."""
        pairs = pairs.select("u", "v")
        wanted = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id")))
        texts = self.texts.join(wanted.distinct(), "id", "left_semi").dropDuplicates(["id"])
        left = texts.select(F.col("id").alias("u"), F.col("text").alias("left"))
        right = texts.select(F.col("id").alias("v"), F.col("text").alias("right"))
        joined = pairs.join(left, "u").join(right, "v").select("u", "left", "v", "right")
        return self.keep(over_batches(joined, _confirmer(self.words, self.num, self.den), "u long, v long"))

    def labelled(self, df: DataFrame, at: str, labels: DataFrame, name: str) -> DataFrame:
        """``df`` with the component of its column ``at``."""
        labels = labels.select(F.col("node").alias(at), F.col("component").alias(name))
        return df.join(labels, at, "left").withColumn(name, F.coalesce(name, at))

    def crossing(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Those pairs that join different components."""
        named = self.labelled(self.labelled(pairs, "u", labels, "_a"), "v", labels, "_b")
        return named.filter("_a <> _b").drop("_a", "_b")

    def mixed(self, postings: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of the lists that hold several components, with their part and the
        largest part of the list."""
        named = self.labelled(postings, "node", labels, "part")
        parts = named.groupBy("value", "part").agg(F.count(F.lit(1)).alias("held"))
        largest = parts.groupBy("value").agg(
            F.max(F.struct("held", "part")).alias("top"), F.count(F.lit(1)).alias("parts")
        )
        largest = largest.filter("parts > 1").select("value", F.col("top.part").alias("most"))
        return named.join(largest, "value")

    def bounded(self, mixed: DataFrame) -> DataFrame:
        """(node, shared, bits): how many shingles of a node others of such lists hold, where
        that can be enough, and its one-bit signature."""
        nodes = self.keep(mixed.select("node", "n").distinct())
        texts = self.texts.join(nodes.select(F.col("node").alias("id")), "id", "left_semi")
        held = over_batches(texts.dropDuplicates(["id"]), _shingler(self.words), "node long, hash long")
        alone = (
            held.groupBy("hash")
            .agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("node"))
            .filter("holders = 1")
            .groupBy("node")
            .agg(F.count(F.lit(1)).alias("alone"))
        )
        shared = F.col("n") - F.coalesce("alone", F.lit(0))
        found = nodes.join(alone, "node", "left").select("node", shared.alias("shared"), "n")
        able = self.keep(found.filter(self.den * F.col("shared") >= self.num * F.col("n")).drop("n"))
        texts = self.texts.join(able.select(F.col("node").alias("id")), "id", "left_semi")
        bits = over_batches(
            texts.dropDuplicates(["id"]), _bit_sketcher(self.words, self.bits), "node long, bits array<long>"
        )
        return self.keep(able.join(bits, "node"))

    def alike(self, left: str, right: str) -> Column:
        """Whether as many bits agree as similar texts have in common."""
        share = (1 + self.num / self.den) / 2
        least = self.bits * share - 4.5 * (self.bits * share * (1 - share)) ** 0.5
        apart = sum(
            F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))) for i in range(self.bits // 64)
        )
        return apart <= int(self.bits - least)

    def reachable(self, n: str, m: str, shared: str, other: str) -> Column:
        """Whether two sets can be similar enough, given what of each is shared at all."""
        most = F.least(shared, other)
        return self.den * most >= self.num * (F.col(n) + F.col(m) - most)

    def left_over(self, mixed: DataFrame, bounds: DataFrame, tested: DataFrame) -> DataFrame:
        """Untested pairs of such lists: nodes outside the largest part with all others."""
        rows = self.keep(mixed.join(bounds, "node"))
        lists = rows.groupBy("node").agg(F.collect_list("value").alias("values"))  # a prefix at most
        rows = self.keep(rows.join(lists, "node"))
        small = rows.filter("part <> most").select(
            "value",
            F.col("node").alias("u"),
            F.col("n").alias("m"),
            F.col("sig").alias("other"),
            F.col("part").alias("own"),
            F.col("shared").alias("mine"),
            F.col("bits").alias("own_bits"),
            F.col("values").alias("own_values"),
        )
        pairs = small.join(rows, "value").filter(
            (F.col("own") != F.col("part"))
            & ((F.col("part") == F.col("most")) | (F.col("u") < F.col("node")))
            & self.reachable("n", "m", "shared", "mine")
            & self.alike("bits", "own_bits")
            & (_agreeing(F.col("sig"), F.col("other")) >= self.matches)
            # Of the lists that both are in, the first makes the pair.
            & (F.array_min(F.array_intersect("values", "own_values")) == F.col("value"))
        )
        pairs = pairs.select("u", F.col("node").alias("v"))
        both = tested.unionByName(tested.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return pairs.join(both, ["u", "v"], "left_anti")


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    num: int = 80,
    den: int = 100,
    coordinates: int = 48,
    matches: int = 27,
    bits: int = 2048,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over
    links with ``den * shared >= num * united``) and kept (id = component_id)."""
    search = _Search(docs, id_col, text_col, words, num, den, coordinates, matches, bits)
    rows = search.sketches()
    classes = (
        rows.filter("n > 0")
        .groupBy("same", "n", "sig")
        .agg(F.min("id").alias("node"))
        .filter("node is not null")
    )
    nodes = search.keep(classes)
    postings = search.postings(nodes.select("node", "n", "sig").dropDuplicates(["node"]))
    met = search.met(postings)
    best = met.groupBy("u").agg(F.max(F.struct("agree", "v")).alias("best")).select("u", "best.v")
    links = search.confirmed(best)
    labels = components(links)
    mixed = search.mixed(postings, labels)
    bounds = search.bounded(mixed)
    able = bounds.select("node")
    crossing = search.crossing(met.join(best, ["u", "v"], "left_anti"), labels)
    crossing = crossing.join(able.withColumnRenamed("node", "u"), "u", "left_semi")
    crossing = search.keep(crossing.join(able.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v"))
    links = search.keep(links.unionByName(search.confirmed(crossing)))
    labels = components(links)
    tested = best.unionByName(crossing)
    pairs = search.keep(search.left_over(search.mixed(postings, labels), bounds, tested))
    if not pairs.isEmpty():
        links = search.keep(links.unionByName(search.confirmed(pairs)))
        labels = components(links)
    named = search.labelled(nodes.select("same", "node"), "node", labels, "part")
    groups = named.groupBy("same").agg(F.min("part").alias("part"))
    found = rows.join(groups, "same", "left")
    component = F.when(F.col("n") > 0, F.col("part")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")
    ).withColumn("kept", F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id")))
