"""Fill-in-the-middle documents: a text cut in three at token ends and put in new order.

Tokens are runs of A-Z and a-z, and every other character (code point) alone. The places
where a token begins or the text ends are a ``BoundarySet`` of code point offsets: member k
is where k tokens end. Both cuts are selected from it by numbers drawn from the SHA-256 of
``1:`` and the id, so they depend on the id and the text alone. The set is built and asked
in Arrow batches; the text itself stays in Spark, which cuts and joins it.

The form of a document is ``plain`` (the text as it is) where the text is empty, holds one of
the marks, or by its draw; else ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix,
middle). Each mark occurs once in the output, so it can be taken apart again.

Defined results: a NULL text counts as empty; a NULL id draws as an empty string; rows that
repeat get equal results; other columns are ignored, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.boundary_set import BoundarySet
from pageloom.llm.common import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUTS = "struct<n: bigint, first: bigint, second: bigint>"

_LETTER = np.zeros(128, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def boundaries(text: str) -> BoundarySet:
    """Offsets in code points between tokens, with 0 and the end of the text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = _LETTER[np.minimum(points, 127)] & (points < 128)
    inside = np.zeros(len(points) + 1, bool)
    inside[1:-1] = letter[:-1] & letter[1:]
    return BoundarySet(np.flatnonzero(~inside))


def cut(text: str, one: int, other: int) -> tuple[int, int, int]:
    """Tokens, and the ends of prefix and middle; the numbers are taken modulo one more
    than the tokens."""
    found = boundaries(text)
    n = len(found) - 1
    first, second = sorted((one % (n + 1), other % (n + 1)))
    return n, found.select(first), found.select(second)


def _cut_column(texts: pa.Array, ones: pa.Array, others: pa.Array) -> pa.Array:
    rows = [cut(*row) for row in zip(texts.to_pylist(), ones.to_pylist(), others.to_pylist())]
    columns = np.array(rows, np.int64).reshape(-1, 3)
    names = ("n", "first", "second")
    return pa.StructArray.from_arrays([pa.array(c) for c in columns.T], names)


def _draw(digest: Column, number: int) -> Column:
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: int = 90, suffix_first: int = 20
) -> DataFrame:
    """Per document: id, n (tokens), form, prefix_chars, middle_chars (NULL if plain) and
    output. A share of ``plain`` in 100 is rearranged, ``suffix_first`` in 100 of those as spm."""
    ship(docs.sparkSession)
    cuts = F.arrow_udf(_cut_column, CUTS)
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest")
    )
    rows = rows.withColumn("cuts", cuts("text", _draw(F.col("digest"), 1), _draw(F.col("digest"), 2)))
    text, first, second = F.col("text"), F.col("cuts.first"), F.col("cuts.second")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= text.contains(mark)
    stays = (text == "") | marked | (_draw(F.col("digest"), 3) % 100 >= plain)
    form = F.when(stays, "plain").when(_draw(F.col("digest"), 4) % 100 < suffix_first, "spm").otherwise("psm")

    def part(begin: Column, end: Column) -> Column:
        return F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))

    prefix, middle = part(F.lit(0), first), part(first, second)
    suffix = F.substring(text, (second + 1).cast("int"), F.lit(2**31 - 1))
    formed = rows.withColumn("form", form)
    is_plain = F.col("form") == "plain"
    return formed.select(
        F.col("id").alias(id_col),
        F.col("cuts.n").alias("n"),
        "form",
        F.when(~is_plain, first).alias("prefix_chars"),
        F.when(~is_plain, second - first).alias("middle_chars"),
        F.when(is_plain, text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text of an output."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
