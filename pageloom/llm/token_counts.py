"""Token counts by a finite-state transducer compiled from a BPE piece model.

The transducer is that of ``piece_machine``: its transitions carry emitted-token counts
and every space after another character leads back to its start.

A text is cut into chunks; the map of
a chunk holds its characters up to the first such return, the count after it and the
last state. Maps compose associatively, so they are combined pairwise, level by level.

Defined results: a NULL or empty text has no tokens; special strings are ordinary
text; rows repeat as they come; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import over_batches
from pageloom.llm.piece_machine import Transducer, few_collections
from pageloom.llm.piece_model import load
from pageloom.llm.piece_normaliser import normaliser

@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(load(path))


def _counter(path: str, chunk_chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, normal = transducer(path), normaliser(path)
        for batch in batches:
            with few_collections():
                counts = [
                    machine.count(normal.text(text.as_py() or ""), chunk_chars) for text in batch.column(1)
                ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    return count


def token_counts(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    chunk_chars: int = 1 << 16,
) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    kind = rows.schema["id"].dataType.simpleString()
    counted = over_batches(
        rows, _counter(model_path, chunk_chars), f"id {kind}, n_bytes long, n_tokens long"
    )
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
