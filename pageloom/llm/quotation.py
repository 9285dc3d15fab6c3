"""Quotation linking: messages without their quotes, in reply order.

A line's level is the number of ``>`` signs it starts with. Runs of quoted lines with one
level are passages. Passages, paragraphs and lines are normalised (white space collapsed,
lower-cased) and hashed; so are the own words of every message. Quotes are joined to own
words by conversation and hash: of a hash the first message that holds it as its own
is the original, which an aggregate finds with a map-side step, so a text that a third of
all messages repeat makes no pairs. A message replies to the original of its least
nested quote, of several the longest piece that matches; without a match, to the message
of the preceding turn. Pointers are doubled until every message knows its first message
and its depth; each round is a written table.

Lines that announce a quote ("... wrote:" right before one) are dropped with it.

Defined results: a NULL text counts as empty; a NULL conversation or turn is linked with
nothing and is its own thread; quotes of later messages or of the message itself are
dropped without a link; of rows that repeat a turn all get the links of that turn; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import over_batches
from pageloom.session import work_dir, written

_MARKS = re.compile(r"[ \t]?(?:>[ \t]?)+")
_ANNOUNCES = re.compile(r"\bwrote:\s*$")
_KEY = pa.struct([("level", pa.int32()), ("size", pa.int64()), ("hash", pa.int64())])


def split_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """Own words and (level, passage) of the quotes, in order."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        level = marks.group().count(">") if marks else 0
        if level:
            if not before:
                while own and not own[-1].strip():
                    own.pop()
                if own and _ANNOUNCES.search(own[-1]):
                    own.pop()
            if level != before:
                quotes.append((level, []))
            quotes[-1][1].append(line[marks.end() :])
        else:
            own.append(line)
        before = level
    return "\n".join(own).strip("\n"), [(level, "\n".join(lines)) for level, lines in quotes]


def pieces(passage: str) -> set[str]:
    """The passage, its paragraphs and its lines, normalised; nothing empty."""
    parts = [passage, *re.split(r"\n[ \t]*\n", passage), *passage.split("\n")]
    return {n for p in parts if (n := " ".join(p.lower().split()))}


def _keys(level: int, passage: str) -> list[dict]:
    return [
        {"level": level, "size": len(p), "hash": xxhash.xxh3_64_intdigest(p.encode()) - (1 << 63)}
        for p in sorted(pieces(passage))
    ]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, own_keys, quote_keys = [], [], []
        for text in batch.column(3):
            own, quotes = split_quotes(text.as_py() or "")
            texts.append(own)
            own_keys.append(_keys(0, own))
            quote_keys.append([key for level, passage in quotes for key in _keys(level, passage)])
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3],
                pa.array(texts, pa.string()),
                pa.array(own_keys, pa.list_(_KEY)),
                pa.array(quote_keys, pa.list_(_KEY)),
            ],
            names=["conv", "turn", "role", "text", "own", "quotes"],
        )


def link_quotes(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per message: conversation, turn, role, text (own words), reply_to (turn or
    NULL), by_quote, thread (turn of the first message), depth (0 there) and formatted
    (role and own words in chat markup). Order by conversation, thread, depth and turn
    to read a conversation in reply order."""
    folder = work_dir(messages.sparkSession)
    key = "array<struct<level:int,size:long,hash:long>>"
    rows = over_batches(
        messages.select(
            F.col(conv_col).cast("long").alias("conv"),
            F.col(turn_col).cast("long").alias("turn"),
            F.col(role_col).alias("role"),
            F.col(text_col).alias("text"),
        ),
        _parse,
        f"conv long, turn long, role string, text string, own {key}, quotes {key}",
    )
    rows = written(rows, f"{folder}/parsed")
    known = rows.filter("conv is not null and turn is not null")
    first = (
        known.select("conv", "turn", F.explode("own").alias("own"))
        .groupBy("conv", F.col("own.hash").alias("hash"))
        .agg(F.min("turn").alias("original"))
    )
    quoted = known.select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", "q.*")
    by_quote = (
        quoted.join(first, ["conv", "hash"])
        .filter("original < turn")
        .groupBy("conv", "turn")
        .agg(F.min(F.struct("level", -F.col("size"), "original")).alias("best"))
        .select("conv", "turn", F.col("best.original").alias("quoted"))
    )
    turns = known.select("conv", "turn").distinct()
    before = turns.select("conv", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("follows"))
    replies = turns.join(by_quote, ["conv", "turn"], "left").join(before, ["conv", "turn"], "left")
    replies = replies.select(
        "conv",
        "turn",
        F.coalesce("quoted", F.when(F.col("follows"), F.col("turn") - 1)).alias("reply_to"),
        F.col("quoted").isNotNull().alias("by_quote"),
    )
    replies = written(replies, f"{folder}/replies")
    at = replies.select(
        "conv",
        "turn",
        F.coalesce("reply_to", "turn").alias("thread"),
        F.col("reply_to").isNotNull().cast("long").alias("depth"),
        F.col("reply_to").isNull().alias("done"),
    )
    # Only messages whose pointer has not met the first message yet go into a round.
    done, ahead, step = [at.filter("done")], at.filter("not done"), 0
    while not ahead.isEmpty():
        step += 1
        known_at = reduce(DataFrame.unionByName, [*done, ahead]).select(
            "conv",
            F.col("turn").alias("thread"),
            F.col("thread").alias("further"),
            F.col("depth").alias("more"),
            F.col("done").alias("ends"),
        )
        moved = ahead.join(known_at, ["conv", "thread"]).select(
            "conv",
            "turn",
            F.col("further").alias("thread"),
            (F.col("depth") + F.col("more")).alias("depth"),
            F.col("ends").alias("done"),
        )
        moved = written(moved, f"{folder}/threads{step}")
        done.append(moved.filter("done"))
        ahead = moved.filter("not done")
    at = reduce(DataFrame.unionByName, done)
    found = replies.join(at.drop("done"), ["conv", "turn"])
    result = rows.drop("own", "quotes").join(found, ["conv", "turn"], "left")
    return result.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        F.col("text").alias(text_col),
        "reply_to",
        F.coalesce("by_quote", F.lit(False)).alias("by_quote"),
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("text")).alias("formatted"),
    )


def as_quoting(conversations: DataFrame) -> DataFrame:
    """Conversations as mail-like messages that quote earlier turns.

    A turn that leaves 1 or 2 modulo 4 quotes the turn before it and, one level deeper,
    the one before that; a turn that leaves 3 quotes the turn two before it; other turns
    quote nothing.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    earlier = rows.select("conv_id", "turn", "text").dropDuplicates(["conv_id", "turn"])

    def back(turns: int) -> DataFrame:
        return earlier.select("conv_id", (F.col("turn") + turns).alias("turn"), F.col("text").alias(f"back{turns}"))

    def quoted(text: str, mark: str):
        return F.concat(F.lit("\n"), F.regexp_replace(text, "(?m)^", mark))

    both = rows.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    one, two = quoted("back1", "> "), quoted("back2", ">> ")
    note = F.lit("\n\nOn Monday someone wrote:")
    text = (
        F.when(F.col("turn") % 4 == 3, F.concat("text", note, quoted("back2", "> ")))
        .when(F.col("turn") % 4 != 0, F.concat("text", note, one, F.coalesce(two, F.lit(""))))
        .otherwise(F.col("text"))
    )
    return both.select("conv_id", "turn", "role", F.coalesce(text, "text").alias("text"))
