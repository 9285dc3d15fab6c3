"""The stream's memory of newest captures: as in batch, over restarts, and no longer than asked."""

import pandas as pd
from pyspark.sql import functions as F

from pageloom.streaming.newest import FOUND, _tracker, known_captures, stream_newest

SCHEMA = "page_id bigint, url string, html string, captured_at timestamp"
KNOWN = "url string, page_id bigint, captured_at timestamp, sha1 string"


class Stream:
    """Waves written as files, each taken in by a run of its own over one checkpoint."""

    def __init__(self, spark, tmp_path, known=None, keep=1_000_000):
        self.spark, self.root, self.known, self.keep = spark, tmp_path, known, keep

    def wave(self, *rows, delay="0 seconds"):
        made = self.spark.createDataFrame([(i, f"https://h/{u}", t, at) for i, u, t, at in rows], "page_id bigint, url string, html string, at bigint")
        made = made.withColumn("captured_at", F.timestamp_seconds("at")).drop("at")
        made.coalesce(1).write.mode("append").parquet(str(self.root / "in"))
        pages = self.spark.readStream.schema(SCHEMA).parquet(str(self.root / "in"))
        known = None
        if self.known is not None:
            known = self.spark.readStream.schema(KNOWN).parquet(self.known)
        query = (
            stream_newest(pages, self.keep, delay, known)
            .writeStream.format("parquet")
            .option("path", str(self.root / "out"))
            .option("checkpointLocation", str(self.root / "check"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        rows = self.spark.read.schema(FOUND).parquet(str(self.root / "out")).collect()
        told = sorted((r.url[len("https://h/"):], r.page_id, r.status) for r in rows)
        state = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        return told, state[-1]


def test_newer_captures_are_told_over_restarts(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    told, size = stream.wave((1, "a", "one", 100), (2, "a#top", "two", 110), (3, "b", "one", 100))
    assert told == [("a", 1, "new"), ("a", 2, "changed"), ("b", 3, "new")] and size == 2
    told, size = stream.wave((4, "a", "two", 120), (5, "c", "x", 125), delay="1 hour")
    assert ("a", 4, "unchanged") in told and ("c", 5, "new") in told and size == 3
    told, _ = stream.wave((6, "a", "late", 115), (7, "b", "two", 130), delay="1 hour")
    assert ("b", 7, "changed") in told and all(i != 6 for _, i, _ in told)


def test_memory_expires(spark, tmp_path):
    stream = Stream(spark, tmp_path, keep=50)
    _, size = stream.wave((1, "a", "one", 100), (2, "b", "one", 100))
    assert size == 2
    stream.wave((3, "c", "one", 200))  # moves the watermark past both
    told, size = stream.wave((4, "c", "one", 210))
    assert size == 1
    told, _ = stream.wave((5, "a", "one", 220))
    assert ("a", 5, "new") in told  # forgotten, so new again
    assert ("c", 4, "unchanged") in told


def test_memory_begins_with_a_batch(spark, tmp_path):
    rows = [(1, "https://h/a", "one", 100), (2, "https://h/a", "two", 110), (3, "https://h/b", "one", 90)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, at bigint")
    pages = pages.withColumn("captured_at", F.timestamp_seconds("at"))
    known = str(tmp_path / "known")
    found = known_captures(pages)
    assert {(r.url, r.page_id) for r in found.collect()} == {("https://h/a", 2), ("https://h/b", 3)}
    found.coalesce(1).write.parquet(known)
    stream = Stream(spark, tmp_path, known)
    told, size = stream.wave((4, "a", "two", 120), (5, "a", "old", 105), (6, "c", "x", 120))
    assert told == [("a", 4, "unchanged"), ("c", 6, "new")] and size == 3


def test_what_tells_nothing_makes_no_frame():
    """The tracker runs once a URL; an empty frame costs more than the comparison."""

    class State:
        hasTimedOut, exists, get = False, True, (200, 9, "one")

        def remove(self):
            self.exists = False

        def update(self, known):
            self.get = known

        def setTimeoutTimestamp(self, at):
            self.until = at

        def getCurrentWatermarkMs(self):
            return 0

    track, state = _tracker(1000), State()
    late = pd.DataFrame({"told": [True], "at": [100], "page_id": [1], "sha1": ["old"]})
    assert list(track(("u",), iter([late]), state)) == [] and state.get == (200, 9, "one")
    newer = pd.DataFrame({"told": [True, False], "at": [400, 300], "page_id": [3, 2], "sha1": ["two", "two"]})
    (found,) = track(("u",), iter([newer]), state)
    assert found.values.tolist() == [["u", 3, 400, "two", "unchanged"]] and list(found.columns) == ["url", "page_id", "at", "sha1", "status"]
    state.hasTimedOut = True
    assert list(track(("u",), iter([]), state)) == [] and not state.exists
