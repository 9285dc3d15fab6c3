"""K1-K5: from saved pages to the export table and its sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.config import HarvestConfig
from pageloom.functions.core import over
from pageloom.functions.render import body_fields, render
from pageloom.functions.urls import content_sha1, crawl_base, domain_key, normalize_seed, slugify_path
from pageloom.operators.aggregates import last_write_wins
from pageloom.operators.content import extract_content
from pageloom.operators.joins import diff_join
from pageloom.schemas import EXPORT, EXPORT_KEYS
from pageloom.session import folder_numbers, removed, work_dir, written

SNAPSHOT_BATCHES = 16  # batches after which a snapshot of what stands is written


def path_below_seed(seed: Column, url: Column, fmt: str) -> Column:
    return slugify_path(crawl_base(normalize_seed(seed)), url, fmt)


def planned_writes(saved: DataFrame, fmt: str) -> DataFrame:
    """One row per output path, decided on ids before any parsing."""
    placed = saved.select(
        over(domain_key, "seed").alias("domain"),
        over(path_below_seed, "seed", "url", fmt=fmt).alias("out_path"),
        F.struct("seed_id", "depth", "ord").alias("ord"),
        "url",
        "page_id",
    )
    return last_write_wins(placed).drop("ord")


def export_rows(
    saved: DataFrame,
    pages: DataFrame,
    cfg: HarvestConfig = HarvestConfig(),
    date: Column | None = None,
    folder: str | None = None,
) -> DataFrame:
    """The export table of saved pages.

    Duplicate paths are settled on ids first, in a table that is written, so Spark knows
    its size when it plans the joins with it. Pages that no path needs are dropped by a
    semi-join on ids before parsing, each page is parsed once, and its content, a
    fraction of the HTML, is joined to the paths. Up to Spark's limit for broadcasts the
    ids go to the pages and HTML stays where it is scanned; beyond it the HTML of
    the pages is exchanged once, unless they lie bucketed by ``page_id``. ``date`` is epoch
    seconds; the hash leaves it out. ``folder`` is where the work table goes, by default a
    new one below the shared work folder.
    """
    writes = written(planned_writes(saved, cfg.format), folder or f"{work_dir(saved.sparkSession)}/writes")
    extra = ["captured_at"] if "captured_at" in pages.columns else []
    bodies = pages.select("page_id", "html", *extra)
    needed = bodies.join(writes.select("page_id"), "page_id", "left_semi")
    content = extract_content(needed, body_fields(cfg.format)).join(writes, "page_id")
    captured = F.col("captured_at") if extra else F.lit(None).cast("timestamp")
    stamp = date if date is not None else F.unix_timestamp(captured)
    return content.select(
        "domain",
        "out_path",
        F.lit(cfg.format).alias("format"),
        "title",
        "url",
        render(cfg.format, F.coalesce(stamp, F.lit(0))).alias("content"),
        content_sha1(render(cfg.format)).alias("content_sha1"),
        captured.alias("captured_at"),
    )


def changed_rows(current: DataFrame, previous: DataFrame) -> DataFrame:
    """K3: rows whose text is not what stands at their path already."""
    old = previous.select(*EXPORT_KEYS, "content_sha1")
    return current.join(old, [*EXPORT_KEYS, "content_sha1"], "left_anti")


def diff_status(current: DataFrame, previous: DataFrame) -> DataFrame:
    """J7 on two export tables."""
    return diff_join(current, previous)


def write_export(export: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1, K2: the table sink, one directory per domain.

    ``rebalance`` lets AQE gather the rows of small domains and split those of a
    domain that holds a large share, so neither tiny files nor one giant task
    come out.
    """
    export.hint("rebalance", "domain").write.mode(mode).partitionBy("domain").parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The batches of an export that are whole: their manifest is written last."""
    return folder_numbers(spark, f"{path}/_manifest")


def _batches(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """The rows of these batches of an export, with their ``batch_id``."""
    schema = f"{EXPORT}, batch_id bigint"
    if not numbers:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/batch_id={n}" for n in numbers]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def standing_hashes(spark: SparkSession, path: str, before: int) -> DataFrame:
    """Hash and capture time of what stands at each path after the batches before
    ``before``; the hash of a path that was removed is NULL. Reads the last snapshot and
    the batches after it, keys and hashes only."""
    state = f"{path}/_standing"
    schema = "domain string, out_path string, format string, content_sha1 string, captured_at timestamp, batch bigint"
    whole = [n for n in versions(spark, path) if n < before]
    snapshots = [n for n in folder_numbers(spark, f"{state}/snapshots") if n in whole]
    last = max(snapshots, default=-1)
    later = [n for n in whole if n > last]
    rows = spark.createDataFrame([], schema)
    for kind, numbers in (("snapshots", snapshots[-1:]), ("batches", later)):
        if numbers:
            folders = [f"{state}/{kind}/batch={n}" for n in numbers]
            read = spark.read.schema(schema).option("basePath", f"{state}/{kind}")
            rows = rows.unionByName(read.parquet(*folders))
    newest = F.max_by(F.struct("content_sha1", "captured_at"), "batch").alias("_newest")
    return rows.groupBy(*EXPORT_KEYS).agg(newest).select(*EXPORT_KEYS, "_newest.*")


def not_late(current: DataFrame, standing: DataFrame) -> DataFrame:
    """Rows that were not captured before what stands at their path."""
    stood = standing.select(*EXPORT_KEYS, F.col("captured_at").alias("_stood"))
    late = F.col("captured_at") < F.col("_stood")
    return (
        current.join(stood, list(EXPORT_KEYS), "left")
        .filter(~F.coalesce(late, F.lit(False)))
        .select(*current.columns)
    )


def write_changes(export: DataFrame, path: str, batch_id: int, complete: bool = False) -> None:
    """K3: write the rows that differ from what stands at their paths, as a new version.

    A capture older than what stands changes nothing. With ``complete`` the export is all
    there is: what stands at other paths is removed, which is noted with a NULL hash. A batch
    owns the folder ``batch_id=N`` and overwrites it, so a batch that is run again after a
    failure leaves one copy; readers see it when its manifest is there, which counts what
    it has written and removed. What stands is kept in narrow tables, one for each batch
    and every ``SNAPSHOT_BATCHES`` one that merges them, so a batch reads a bounded number.
    """
    spark = export.sparkSession
    folder, state = work_dir(spark), f"{path}/_standing"
    removed(spark, f"{path}/_manifest/batch={batch_id}")
    standing = written(standing_hashes(spark, path, batch_id), f"{folder}/standing")
    current = written(not_late(export, standing), f"{folder}/current")
    write_export(changed_rows(current, standing), f"{path}/batch_id={batch_id}")
    narrow = current.select(*EXPORT_KEYS, "content_sha1", "captured_at")
    if complete:
        narrow = narrow.unionByName(vanished_rows(export, standing))
    narrow.write.mode("overwrite").parquet(f"{state}/batches/batch={batch_id}")
    own = spark.read.schema(narrow.schema).parquet(f"{state}/batches/batch={batch_id}")
    if batch_id % SNAPSHOT_BATCHES == SNAPSHOT_BATCHES - 1:
        kept = standing.join(own, list(EXPORT_KEYS), "left_anti")
        kept.unionByName(own).write.mode("overwrite").parquet(f"{state}/snapshots/batch={batch_id}")
    manifest = [(_batches(spark, path, [batch_id]).count(), own.filter("content_sha1 IS NULL").count())]
    told = spark.createDataFrame(manifest, "written bigint, removed bigint")
    told.write.mode("overwrite").parquet(f"{path}/_manifest/batch={batch_id}")
    removed(spark, folder)


def vanished_rows(export: DataFrame, standing: DataFrame) -> DataFrame:
    """Paths that stand and are not in a complete export, without a hash."""
    keys = list(EXPORT_KEYS)
    gone = standing.filter("content_sha1 IS NOT NULL").join(export.select(*keys), keys, "left_anti")
    nothing = {"content_sha1": F.lit(None).cast("string"), "captured_at": F.lit(None).cast("timestamp")}
    return gone.select(*keys, *[value.alias(name) for name, value in nothing.items()])


def standing_export(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The documents an export kept in batches holds now, or held after ``version``."""
    numbers = [n for n in versions(spark, path) if version is None or n <= version]
    if version is not None and version not in numbers:
        raise ValueError(f"no version {version}; there are {numbers}")
    rows = _batches(spark, path, numbers)
    live = standing_hashes(spark, path, max(numbers, default=-1) + 1).filter("content_sha1 IS NOT NULL")
    newest = rows.groupBy(*EXPORT_KEYS).agg(F.max("batch_id").alias("batch_id"))
    newest = newest.join(live.select(*EXPORT_KEYS), list(EXPORT_KEYS), "left_semi")
    return rows.join(newest, [*EXPORT_KEYS, "batch_id"], "left_semi").drop("batch_id")


def export_log(spark: SparkSession, path: str) -> DataFrame:
    """``version, written, removed`` of each version."""
    schema = "written bigint, removed bigint, batch bigint"
    folders = [f"{path}/_manifest/batch={n}" for n in versions(spark, path)]
    if not folders:
        return spark.createDataFrame([], "version bigint, written bigint, removed bigint")
    rows = spark.read.schema(schema).option("basePath", f"{path}/_manifest").parquet(*folders)
    return rows.select(F.col("batch").alias("version"), "written", "removed")


def raw_html_rows(
    saved: DataFrame, pages: DataFrame, cfg: HarvestConfig = HarvestConfig()
) -> DataFrame:
    """K4: sibling rows with the captured HTML, next to each exported file. Nothing is
    parsed; paths are settled on ids, as in ``export_rows``."""
    writes = planned_writes(saved, cfg.format).select("domain", "out_path", "page_id")
    writes = written(writes, f"{work_dir(saved.sparkSession)}/writes")
    return writes.join(pages.select("page_id", "html"), "page_id").select(
        "domain",
        F.regexp_replace("out_path", r"\.[^./]+\z", ".raw.html").alias("out_path"),
        F.lit("html").alias("format"),
        F.col("html").alias("content"),
    )
