"""ST1 with a memory that expires: what is known of a URL is its newest capture.

State holds for each URL the time, id and text hash of its newest capture, never HTML and
nothing for a whole site. It goes when the watermark is ``keep`` past that capture, so a
stream that runs for years holds the URLs of that span only. Captures older than what is
known, or than the watermark, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from pageloom.functions.core import over
from pageloom.functions.urls import content_sha1
from pageloom.operators.filters import response_gate
from pageloom.operators.joins import page_key

FOUND = "url string, page_id bigint, captured_at timestamp, sha1 string, status string"
_FOUND = "url string, page_id bigint, at bigint, sha1 string, status string"
_STATE = "at bigint, page_id bigint, sha1 string"


def known_captures(pages: DataFrame) -> DataFrame:
    """``url, page_id, captured_at, sha1`` of the newest capture of each URL of a batch, as
    the stream's memory to begin with."""
    own = pages.filter(response_gate(pages)).select(
        over(page_key, "url").alias("url"), "page_id", "captured_at", content_sha1(F.col("html")).alias("sha1")
    )
    newest = own.groupBy("url").agg(F.max(F.struct("captured_at", "page_id", "sha1")).alias("_newest"))
    return newest.select("url", "_newest.*").select("url", "page_id", "captured_at", "sha1")


def _tracker(keep_ms: int):
    """One URL's captures of a batch, in order of time, against what is known of it. Called
    for every URL, so it makes no frame that it can spare and none of records."""

    def track(key: tuple, parts: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else None
        rows = sorted(  # what is known from a batch comes first
            (bool(told), int(at), int(page_id), sha1)
            for part in parts
            for told, at, page_id, sha1 in zip(*[part[c].array for c in ("told", "at", "page_id", "sha1")])
        )
        out = []
        for told, at, page_id, sha1 in rows:
            if known is not None and (at, page_id) <= (known[0], known[1]):
                continue
            status = "new" if known is None else "unchanged" if sha1 == known[2] else "changed"
            known = (at, page_id, sha1)
            if told:
                out.append((key[0], page_id, at, sha1, status))
        if known is not None:
            state.update(known)
            state.setTimeoutTimestamp(max(known[0] // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            columns = ("url", "page_id", "at", "sha1", "status")
            yield pd.DataFrame(dict(zip(columns, map(list, zip(*out)))))

    return track


def stream_newest(
    pages: DataFrame, keep_seconds: int, delay: str = "1 hour", known: DataFrame | None = None
) -> DataFrame:
    """Captures of a stream that are newer than what is known of their URL, as ``url,
    page_id, captured_at, sha1, status`` (new, changed or unchanged).

    ``pages`` need ``captured_at``; refused responses do not count. ``known`` is a stream of
    ``known_captures`` as batch has written them: it sets the memory and is not told. Where
    the state is to lie in RocksDB rather than in memory, set
    ``spark.sql.streaming.stateStore.providerClass``.
    """

    def rows(stream: DataFrame, told: bool) -> DataFrame:
        return stream.select("url", "page_id", "captured_at", "sha1", F.lit(told).alias("told"))

    own = pages.filter(response_gate(pages)).withColumns(
        {"url": over(page_key, "url"), "sha1": content_sha1(F.col("html"))}
    )
    captures = rows(own, True)
    if known is not None:
        captures = captures.unionByName(rows(known, False))
    captures = captures.withWatermark("captured_at", delay).withColumn("at", F.unix_micros("captured_at"))
    found = captures.groupBy("url").applyInPandasWithState(
        _tracker(1000 * keep_seconds), _FOUND, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select("url", "page_id", F.timestamp_micros("at").alias("captured_at"), "sha1", "status")
