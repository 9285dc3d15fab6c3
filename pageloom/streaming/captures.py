"""ST1 and ST2: the two stateful parts of a harvest over arriving captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pageloom.config import HarvestConfig
from pageloom.functions.core import over
from pageloom.functions.urls import content_sha1
from pageloom.operators.filters import response_gate
from pageloom.operators.joins import latest_captures, page_key, robots_policies, scope_join
from pageloom.plans.crawl import base_of, select_urls
from pageloom.plans.export import export_rows, write_changes
from pageloom.schemas import PAGES
from pageloom.session import removed, work_dir, written


def stream_pages(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    """Captures as files arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def stream_dedup(pages: DataFrame, by: str = "url", delay: str | None = None) -> DataFrame:
    """ST1: first capture of each URL (``by='url'``) or text (``by='sha1'``).

    State is keyed by URL or hash, never by site. With ``delay`` and a
    ``captured_at`` column, state older than the watermark is dropped; without, it
    grows with the stream, which a long-running one should keep in the RocksDB store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = pages.withColumn(
        by, over(page_key, "url") if by == "url" else content_sha1(F.col("html"))
    )
    if delay and "captured_at" in pages.columns:
        return keyed.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark([by])
    return keyed.dropDuplicates([by])


def stream_diff_export(
    pages: DataFrame,
    seeds: DataFrame,
    path: str,
    checkpoint: str,
    cfg: HarvestConfig,
    robots: DataFrame | None = None,
) -> DataStreamWriter:
    """ST2: exports new captures, writing only what changed.

    As in a batch harvest, refused responses, URLs against the patterns, the language
    and robots rules do not count, and of several captures of a URL the newest does: in
    a batch by capture time, then id; over batches a late capture changes nothing. The
    gated batch is written once on narrow columns; HTML is read for the pages left.
    """
    folder = work_dir(pages.sparkSession)
    scopes = written(seeds.withColumn("scope", over(base_of, "seed")), f"{folder}/scopes")
    policies = None
    if robots is not None:
        policies = written(robots_policies(robots, cfg.agent), f"{folder}/robots")
    timed = "captured_at" in pages.columns

    def export_batch(batch: DataFrame, batch_id: int) -> None:
        captures = batch.select(
            over(page_key, "url").alias("url"),
            "page_id",
            *(["captured_at"] if timed else []),
            response_gate(batch).alias("ok"),
        )
        newest = latest_captures(captures, "url", "ok", *(["captured_at"] if timed else []))
        urls = select_urls(newest.filter("ok").drop("ok"), policies, cfg)
        own = f"{folder}/batches/{batch_id}"
        urls = written(urls, f"{own}/urls")
        when = [F.coalesce(F.unix_micros("captured_at"), F.lit(0))] if timed else []
        saved = scope_join(urls, scopes).select(
            "seed_id",
            "seed",
            "url",
            F.lit(0).alias("depth"),
            F.array(*when, F.col("page_id")).alias("ord"),
            "page_id",
        )
        write_changes(export_rows(saved, batch, cfg, folder=f"{own}/writes"), path, batch_id)
        removed(batch.sparkSession, own)

    return (
        pages.writeStream.foreachBatch(export_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
