"""Scoring by a Katz backoff model of word pairs, learned from part of the documents.

A text is lower-cased (A-Z) and split into words ``[^\\x20\\x09-\\x0D]+``, followed by an
end. The first word follows a beginning, which is never predicted. A pair that training has
seen ``c`` times after a history of ``t`` tokens has the probability d(c) * c / t, where d
is the Good-Turing discount of small counts; what the discounts of a history free goes to
the words it has not been seen with, in proportion to their own probability, by a weight
that makes the sum exactly 1. Words are discounted in the same way, and what that frees is
the probability of the one unknown word. After an unseen history only the word counts.

    P(w | v) = d2(c(v w)) c(v w) / t(v)        if c(v w) > 0
             = b(v) P(w)                       if t(v) > 0
             = P(w)                            else

Where count frequencies give a discount outside 0 ... 1, all of that order are 1 - 0.5 / c.
A history without a small count frees nothing; it counts as one token longer, and that one
is what it frees.

How the tables are spread. Documents are read once, in blocks of about ``block_tokens``,
each with a dictionary of its words. Words are numbered and counted in ``word_buckets``
groups by hash. Pairs go to ``buckets`` groups by their history, each block's distinct pairs
once, with the places of the documents that hold them; there counts, discounted sums and
backoff weights come about, and the logarithms are summed for each document of a block. A
history of more than ``hot`` tokens, or of a 16,384th of the corpus where that is more, is
split by the word that follows; there are at most 16,384 such, whose sums are added up and
shared. All groups come from Spark's shuffle. The model stays in two tables, ``words`` and
``grams``, a packed row for each group.

Discounts need the count frequencies of the whole corpus, which are known after the groups
are counted. Logarithms of discounts are therefore kept as counts of their uses, and what
a history frees as its numbers of small counts, until the last step.

Defined results: a NULL or empty text is an end alone. With nothing to learn from every
token is the unknown word, which then has probability 1. Rows repeat as they come, each is
learned from; ids may be NULL or repeat; other columns are ignored, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import fold, over_batches, saved, ship
from pageloom.llm.packing import (
    mixed,
    one_list,
    pack,
    pack_floats,
    pack_words,
    slices,
    unpack,
    unpack_floats,
    unpack_words,
)

SMALL = 5  # counts up to this are discounted
END = b"\n"  # no word, as words hold no white space
BEGIN = 0  # number of the beginning; words are numbered from 1
HOT_SHARE = 1 << 14

_ANSWERS = "block long, bucket int, ids binary, counts binary, words binary, stats array<long>"
_PUSHED = """bucket int, hot boolean, block long, rows int, v binary, runs binary, w binary,
    w_count binary, learned binary, uses binary, places binary, base binary, known binary, sizes binary"""
_SUMS = """bucket int, block long, logs binary, small binary, open_doc binary, open_at binary,
    open_small binary, hot_doc binary, hot_v binary, hot_seen binary, v binary, runs binary, w binary,
    counts binary, hot_sums array<struct<v long, total long, small array<long>, lower double>>,
    stats array<long>, base binary, known binary, sizes binary"""


def discounts(frequencies: list[int]) -> list[float]:
    """d(1) ... d(SMALL) of the numbers of types seen 1 ... SMALL + 1 times."""
    n = [0, *frequencies]
    if all(n[1:]):
        cut = (SMALL + 1) * n[SMALL + 1] / n[1]
        found = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if cut != 1 else 0 for r in range(1, SMALL + 1)]
        if all(0 < d < 1 for d in found):
            return found
    return [1 - 0.5 / r for r in range(1, SMALL + 1)]


def _freed(small: np.ndarray, discount: list[float]) -> np.ndarray:
    """What histories with these numbers of small counts free, in tokens; 1 if nothing."""
    weights = np.arange(1, SMALL + 1) * (1 - np.array(discount))
    return np.where(small.sum(axis=-1) > 0, small @ weights, 1.0)


@dataclass(frozen=True)
class Words:
    """What is known of single words."""

    tokens: int
    types: int
    texts: int
    discount: list[float]
    frequencies: list[int]

    def chance(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by their count; of the unknown word where that is 0."""
        small = np.array(self.frequencies[:SMALL])
        total = self.tokens + (small.sum() == 0)
        factor = np.array([0.0, *self.discount, 1.0])[np.minimum(counts, SMALL + 1)]
        return np.where(counts > 0, factor * counts, _freed(small, self.discount)) / total


@dataclass(frozen=True)
class KatzModel:
    words: Words
    discount: list[float]  # of pairs
    word_table: DataFrame  # packed: bucket, words, ids, counts
    gram_table: DataFrame  # packed: bucket, v, runs, w, counts


def _blocks(block_tokens: int, buckets: int):
    """Rows (id, learns, text) to blocks: codes of all tokens and, by bucket, the words."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        tokens: list[bytes] = []
        sizes: list[int] = []
        ids: list[pa.Array] = []
        learns: list[pa.Array] = []

        def emit() -> pa.RecordBatch:
            own = sorted(set(tokens))
            dealt = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in own], np.int64)
            order = np.argsort(dealt, kind="stable")
            own, dealt = [own[i] for i in order], dealt[order]
            codes = np.fromiter(map(dict(zip(own, range(len(own)))).__getitem__, tokens), np.int64, len(tokens))
            teaches = np.concatenate([x.to_numpy(zero_copy_only=False) for x in learns]).astype(bool)
            counts = np.bincount(codes[np.repeat(teaches, sizes)], minlength=len(own))
            cuts = np.flatnonzero(np.diff(dealt, prepend=-1, append=buckets))
            asks = [
                {"bucket": int(dealt[a]), "words": pack_words(own[a:b]), "counts": pack(counts[a:b])}
                for a, b in zip(cuts[:-1], cuts[1:])
            ]
            kind = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    one_list(pa.concat_arrays(ids)),
                    pa.array([pack(np.array(sizes))], pa.binary()),
                    pa.array([pack(teaches)], pa.binary()),
                    pa.array([pack(codes)], pa.binary()),
                    pa.array([asks], kind),
                ],
                names=["block", "ids", "sizes", "learns", "codes", "asks"],
            )

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            begun = 0
            for i in range(batch.num_rows):
                found = (texts[i].as_py() or b"").lower().split()
                tokens += found
                tokens.append(END)
                sizes.append(len(found) + 1)
                if len(tokens) >= block_tokens or i == batch.num_rows - 1:
                    ids.append(batch.column(0).slice(begun, i + 1 - begun))
                    learns.append(batch.column(1).slice(begun, i + 1 - begun))
                    begun = i + 1
                if len(tokens) >= block_tokens:
                    yield emit()
                    number += 1
                    tokens, sizes, ids, learns = [], [], [], []
        if sizes:
            yield emit()

    return block


def _frequencies(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, SMALL + 2), minlength=SMALL + 3)[1 : SMALL + 2].tolist()


def _numberer(buckets: int):
    """Numbers and counts the words of a bucket, and answers each block in its order."""

    def number(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        asked = [unpack_words(x) for x in rows["words"].to_pylist()]
        own = sorted(set().union(*asked))
        at = dict(zip(own, range(len(own))))
        places = [np.fromiter(map(at.__getitem__, words), np.int64, len(words)) for words in asked]
        counts = np.zeros(len(own), np.int64)
        for place, found in zip(places, rows["counts"].to_pylist()):
            counts[place] += unpack(found)
        ends = int(counts[at[END]]) if END in at else 0
        known = np.flatnonzero(counts)
        out = [
            {"block": b, "bucket": bucket, "ids": pack(1 + p * buckets + bucket, True), "counts": pack(counts[p])}
            for b, p in zip(rows["block"].to_pylist(), places)
        ]
        out.append(
            {
                "bucket": bucket,
                "ids": pack(1 + known * buckets + bucket, True),
                "counts": pack(counts[known]),
                "words": pack_words([own[i] for i in known]),
                "stats": [int(counts.sum()), len(known), ends, *_frequencies(counts)],
            }
        )
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        names = ["block", "bucket", "ids", "counts", "words", "stats"]
        return pa.Table.from_pylist(out, pa.schema(list(zip(names, kinds))))

    return number


def _names(schema: str) -> list[str]:
    """Column names of a DDL string, at its top level."""
    out, depth, part = [], 0, ""
    for char in schema + ",":
        depth += (char == "<") - (char == ">")
        if char == "," and not depth:
            out.append(part.split()[0])
            part = ""
        else:
            part += char
    return out


_HOT_SUM = pa.struct(
    [("v", pa.int64()), ("total", pa.int64()), ("small", pa.list_(pa.int64())), ("lower", pa.float64())]
)
_KINDS = {"bucket": pa.int32(), "block": pa.int64(), "hot": pa.bool_(), "rows": pa.int32()}
_KINDS |= {"stats": pa.list_(pa.int64()), "hot_sums": pa.list_(_HOT_SUM)}


def _rows(schema: str, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([(n, _KINDS.get(n, pa.binary())) for n in _names(schema)]))


def _pusher(words: Words, buckets: int, hot: int):
    """A block and the answers on its words to its pairs, dealt out by history."""
    limit = max(hot, words.tokens // HOT_SHARE)
    share = math.log10(words.tokens + words.types + 1)

    def push(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _rows(_PUSHED, [])
        row = block.drop_columns(["ids"]).to_pylist()[0]
        found = sorted(answers.select(["bucket", "ids", "counts"]).to_pylist(), key=lambda r: r["bucket"])
        ids = np.concatenate([unpack(r["ids"], True) for r in found])
        counts = np.concatenate([unpack(r["counts"]) for r in found])
        codes, sizes = unpack(row["codes"]), unpack(row["sizes"])
        docs = np.repeat(np.arange(len(sizes)), sizes)
        teaches = unpack(row["learns"])[docs]
        after = np.concatenate([[0], codes[:-1] + 1])
        after[np.cumsum(sizes) - sizes] = 0

        order = np.argsort(after * len(ids) + codes, kind="stable")
        starts = np.flatnonzero(np.diff((after * len(ids) + codes)[order], prepend=-1))
        uses = np.diff(starts, append=len(order))
        learned = np.add.reduceat(teaches[order], starts)
        before, word = after[order][starts], codes[order][starts]
        v, v_count = np.concatenate([[BEGIN], ids])[before], np.concatenate([[words.texts], counts])[before]
        w, w_count = ids[word], counts[word]
        split = v_count > limit
        part = np.where(split, mixed(w) % np.maximum(1, -(-v_count // limit)), 0)
        dealt = 2 * (mixed(v ^ mixed(part + 1)) % buckets) + split
        out = []
        sort = np.lexsort((w, v, dealt))
        cuts = np.flatnonzero(np.diff(dealt[sort], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = sort[a:b]
            firsts = np.flatnonzero(np.diff(v[at], prepend=-1))
            out.append(
                {
                    "bucket": int(dealt[at[0]]) // 2,
                    "hot": bool(split[at[0]]),
                    "block": row["block"],
                    "rows": len(sizes),
                    "v": pack(v[at][firsts], True),
                    "runs": pack(np.diff(firsts, append=len(at))),
                    "w": pack(w[at]),
                    "w_count": pack(w_count[at]),
                    "learned": pack(learned[at]),
                    "uses": pack(uses[at]),
                    "places": pack(docs[order[slices(starts[at], uses[at])]]),
                }
            )
        seen = counts[codes]
        out.append(  # on its way to the last step, with the sums of the texts
            {
                "bucket": int(mixed(np.array([row["block"]]))[0] % buckets),
                "block": row["block"],
                "rows": len(sizes),
                "base": pack_floats(np.bincount(docs, np.log10(seen + 1) - share, len(sizes))),
                "known": pack(np.bincount(docs, seen > 0, len(sizes)).astype(np.int64)),
                "sizes": pack(sizes),
            }
        )
        return _rows(_PUSHED, out)

    return push


def _counter(words: Words):
    """Counts the pairs of a bucket and sums up, for each document of each block."""

    def count(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        out: list[dict] = []
        frequencies = np.zeros(SMALL + 1, np.int64)
        everything = table.to_pylist()
        out += [
            {"block": r["block"], "base": r["base"], "known": r["known"], "sizes": r["sizes"]}
            for r in everything
            if r["base"] is not None
        ]
        for hot in (False, True):
            rows = sorted((r for r in everything if r["base"] is None and r["hot"] == hot), key=lambda r: r["block"])
            if not rows:
                continue
            v = np.concatenate([np.repeat(unpack(r["v"], True), unpack(r["runs"])) for r in rows])
            w, w_count, learned = (
                np.concatenate([unpack(r[name]) for r in rows]) for name in ("w", "w_count", "learned")
            )
            ends = np.cumsum([len(unpack(r["w"])) for r in rows])
            history, rank = np.unique(v, return_inverse=True)
            key = rank * (w.max() + 1) + w
            order = np.argsort(key, kind="stable")
            new = np.diff(key[order], prepend=-1) != 0
            gram = np.empty(len(key), np.int64)
            gram[order] = np.cumsum(new) - 1
            first = order[new]
            total = np.add.reduceat(learned[order], np.flatnonzero(new))
            own = rank[first]
            lower = np.bincount(own, np.where(total > 0, words.chance(w_count[first]), 0), len(history))
            length = np.bincount(own, total, len(history)).astype(np.int64)
            few = (total > 0) & (total <= SMALL)
            small = np.bincount(own[few] * SMALL + total[few] - 1, minlength=SMALL * len(history))
            small = small.reshape(-1, SMALL)
            frequencies += np.array(_frequencies(total))
            kept = np.flatnonzero(total)
            if len(kept):
                firsts = np.flatnonzero(np.diff(own[kept], prepend=-1))
                model = {
                    "v": pack(history[own[kept]][firsts], True),
                    "runs": pack(np.diff(firsts, append=len(kept))),
                    "w": pack(w[first][kept]),
                    "counts": pack(total[kept]),
                }
                out.append(model)
            if hot:
                sums = zip(history.tolist(), length.tolist(), small.tolist(), lower.tolist())
                names = ("v", "total", "small", "lower")
                out.append({"hot_sums": [dict(zip(names, x)) for x in sums]})
                at_history = np.zeros(len(history))
            else:
                longer = length + (small.sum(axis=1) == 0)
                at_history = np.log10(np.maximum(longer, 1))
                at_open = -at_history - np.log10(1 - lower)
            log_word = np.log10(words.chance(w_count))
            for row, begin, end in zip(rows, [0, *ends[:-1]], ends):
                uses, places = unpack(row["uses"]), unpack(row["places"])
                pair = np.repeat(np.arange(begin, end), uses)
                count_, at = total[gram[pair]], rank[pair]
                seen = count_ > 0
                log = np.where(seen, np.log10(np.maximum(count_, 1)) - at_history[at], log_word[pair])
                told = {"block": row["block"]}
                if hot:
                    told |= {"hot_doc": pack(places), "hot_v": pack(history[at]), "hot_seen": pack(seen)}
                else:
                    unseen = np.flatnonzero(~seen & (length[at] > 0))
                    log[unseen] += at_open[at[unseen]]
                    which, index = np.unique(at[unseen], return_inverse=True)
                    told |= {"open_doc": pack(places[unseen]), "open_at": pack(index)}
                    told |= {"open_small": pack(small[which].ravel())}
                few = seen & (count_ <= SMALL)
                used = np.bincount(places[few] * SMALL + count_[few] - 1, minlength=SMALL * row["rows"])
                told |= {"logs": pack_floats(np.bincount(places, log, row["rows"])), "small": pack(used)}
                out.append(told)
        out.append({"stats": frequencies.tolist()})
        return _rows(_SUMS, [{"bucket": bucket} | r for r in out])

    return count


def _finisher(discount: list[float], hot: np.ndarray):
    """``hot`` has history, total, numbers of small counts and lower sum in its rows."""
    log_discount = np.log10(discount)
    hot_v = hot[:, 0].astype(np.int64)
    free = hot[:, 2 : 2 + SMALL]
    hot_total = np.log10(np.maximum(1, hot[:, 1] + (free.sum(axis=1) == 0)))
    hot_open = np.log10(_freed(free, discount)) - hot_total - np.log10(1 - hot[:, -1])

    def finish(sums: pa.Table, block: pa.Table) -> pa.Table:
        names = ["id", "n_tokens", "n_known", "base_score", "score"]
        if not block.num_rows:
            return pa.Table.from_arrays([pa.array([], block["ids"].type.value_type), *[pa.array([])] * 4], names)
        rows = sorted(sums.to_pylist(), key=lambda r: (r["bucket"], r["hot_doc"] is not None))
        own = next(r for r in rows if r["base"] is not None)
        score = np.zeros(len(unpack(own["sizes"])))
        for r in rows:
            if r["logs"] is None:
                continue
            score += unpack_floats(r["logs"]) + unpack(r["small"]).reshape(-1, SMALL) @ log_discount
            if r["hot_doc"] is not None:
                at = np.searchsorted(hot_v, unpack(r["hot_v"]))
                log = np.where(unpack(r["hot_seen"]) > 0, -hot_total[at], hot_open[at])
                score += np.bincount(unpack(r["hot_doc"]), log, len(score))
            else:
                log = np.log10(_freed(unpack(r["open_small"]).reshape(-1, SMALL), discount))
                score += np.bincount(unpack(r["open_doc"]), log[unpack(r["open_at"])], len(score))
        return pa.Table.from_arrays(
            [
                block["ids"].combine_chunks().flatten(),
                pa.array(unpack(own["sizes"])),
                pa.array(unpack(own["known"])),
                pa.array(unpack_floats(own["base"])),
                pa.array(score),
            ],
            names,
        )

    return finish


def katz_scores(
    docs: DataFrame,
    learns: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = 1 << 20,
    word_buckets: int = 512,
    bucket_tokens: int = 1 << 21,
    hot: int = 1 << 18,
) -> tuple[DataFrame, KatzModel]:
    """Scores of every whole text by the model of the rows where ``learns`` holds: id,
    n_tokens, n_known, train_tokens, base_score (add-one) and score, in log10; and the
    model."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(learns, F.lit(False)).alias("learns"), F.col(text_col).alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    blocks = over_batches(
        rows,
        _blocks(block_tokens, word_buckets),
        f"block long, ids array<{kind}>, sizes binary, learns binary, codes binary, "
        "asks array<struct<bucket: int, words: binary, counts: binary>>",
    )
    blocks = saved(blocks, "blocks")
    asks = blocks.select("block", F.inline("asks"))
    answers = saved(asks.groupBy("bucket").applyInArrow(_numberer(word_buckets), _ANSWERS), "answers")
    word_table = answers.filter("block IS NULL")
    told = word_table.agg(*[F.sum(F.col("stats")[i]) for i in range(4 + SMALL)]).first()
    tokens, types, texts, *frequencies = [int(x or 0) for x in told]
    words = Words(tokens, types, texts, discounts(frequencies), frequencies)

    buckets = max(64, -(-tokens // bucket_tokens))
    pushed = (
        blocks.drop("asks")
        .groupBy("block")
        .cogroup(answers.filter("block IS NOT NULL").drop("words", "stats").groupBy("block"))
        .applyInArrow(_pusher(words, buckets, hot), _PUSHED)
    )
    sums = saved(pushed.groupBy("bucket").applyInArrow(_counter(words), _SUMS), "sums")
    found = sums.filter("stats IS NOT NULL").agg(*[F.sum(F.col("stats")[i]) for i in range(SMALL + 1)]).first()
    discount = discounts([int(x or 0) for x in found])
    # At most HOT_SHARE histories, as each has that share of all tokens or more.
    parts = sums.select(F.inline("hot_sums")).groupBy("v").agg(
        F.sum("total"), *[F.sum(F.col("small")[i]) for i in range(SMALL)], F.sum("lower")
    )
    shared = np.array([list(r) for r in parts.orderBy("v").collect()], np.float64).reshape(-1, SMALL + 3)

    of_texts = sums.filter("block IS NOT NULL").drop("hot_sums", "stats", "v", "runs", "w", "counts")
    scores = (
        of_texts.groupBy("block")
        .cogroup(blocks.select("block", "ids").groupBy("block"))
        .applyInArrow(
            _finisher(discount, shared), f"id {kind}, n_tokens long, n_known long, base_score double, score double"
        )
    )
    scores = scores.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
    gram_table = sums.filter("w IS NOT NULL").select("bucket", "v", "runs", "w", "counts")
    word_table = word_table.select("bucket", "words", "ids", "counts")
    return scores, KatzModel(words, discount, word_table, gram_table)


def _open_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            columns = [
                pa.array([w.decode() for w in unpack_words(row["words"])], pa.string()),
                pa.array(unpack(row["ids"], True)),
                pa.array(unpack(row["counts"])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "id", "count"])


def _open_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            v = np.repeat(unpack(row["v"], True), unpack(row["runs"]))
            columns = [pa.array(v), pa.array(unpack(row["w"])), pa.array(unpack(row["counts"]))]
            yield pa.RecordBatch.from_arrays(columns, names=["history", "id", "count"])


def _factor(count: Column, discount: list[float]) -> Column:
    found = F.lit(1.0)
    for r, d in enumerate(discount, 1):
        found = F.when(count == r, F.lit(d)).otherwise(found)
    return found


def model_words(model: KatzModel) -> DataFrame:
    """word, id, count and probability of each known word; the rest to 1 is the unknown
    word's."""
    rows = over_batches(model.word_table, _open_words, "word string, id long, count long")
    total = model.words.tokens + (sum(model.words.frequencies[:SMALL]) == 0)
    chance = _factor(F.col("count"), model.words.discount) * F.col("count") / total
    return rows.withColumn("probability", chance)


def model_grams(model: KatzModel) -> DataFrame:
    """history, id and count of each pair seen."""
    return over_batches(model.gram_table, _open_grams, "history long, id long, count long")


def model_backoffs(model: KatzModel) -> DataFrame:
    """history, total (the divisor of its counts) and backoff weight of each history."""
    grams = model_grams(model).join(model_words(model).select("id", "probability"), "id")
    freed = F.sum((1 - _factor(F.col("count"), model.discount)) * F.col("count"))
    return (
        grams.groupBy("history")
        .agg(F.sum("count").alias("seen"), freed.alias("freed"), F.sum("probability").alias("lower"))
        .select(
            "history",
            (F.col("seen") + F.when(F.col("freed") > 0, 0).otherwise(1)).alias("total"),
            F.when(F.col("freed") > 0, F.col("freed")).otherwise(1.0).alias("freed"),
            "lower",
        )
        .select("history", "total", (F.col("freed") / F.col("total") / (1 - F.col("lower"))).alias("backoff"))
    )


def lm_scores(docs: DataFrame, folds: int = 7, held_out: int = 2, **options) -> DataFrame:
    """Learns from all folds but one and scores every document: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score."""
    ship(docs.sparkSession)
    out = fold(F.col("doc_id"), folds) == held_out
    scores, _ = katz_scores(docs, ~out, **options)
    return scores.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
