"""Session settings, and where a plan leaves pure DataFrames: work tables that are written
and read again, bucketed by a key where many joins on it follow."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Runtime settings the library relies on. Skewed joins are split by AQE, so the
# hot key of a site that holds a third of all pages is shared between tasks.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Bounds what a Python worker holds at once, however long the pages are.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}

def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pageloom")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan with fewer splits than there are cores, dealt out to all of them.

    A file is split at its row groups only, so a small table of one group is one task,
    however many cores wait. For plain scans: their splits are known without a job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan._jdf.rdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, F.col(key))


def work_dir(spark: SparkSession, root: str | None = None) -> str:
    """A new folder that all nodes share: below ``root`` if given, else below
    ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Only a local session without any of them gets a folder of its own.
    """
    context = spark.sparkContext
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        chosen = context._jsc.sc().getCheckpointDir()
        root = chosen.get() if chosen.isDefined() else None
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all nodes share")
        root = tempfile.mkdtemp(prefix="pageloom-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/pageloom/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage, survives lost executors
    and gives the planner true sizes."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, path: str, **wanted: Column) -> tuple[DataFrame, dict]:
    """``written``, with aggregates of the rows that come out of the same job."""
    seen = Observation()
    rules = [rule.alias(name) for name, rule in wanted.items()]
    table = written(df.observe(seen, *rules), path)
    try:
        return table, seen.get
    except Py4JJavaError:  # rows that turned out to be none are not observed
        return table, table.agg(*rules).first().asDict()


BUCKET_ROWS = 1 << 14  # rows of a work table that are worth a bucket of their own


class Bucketed(NamedTuple):
    """A work table whose rows lie in files by hash of a key: a join on the key moves the
    other side only, as often as it is read."""

    rows: DataFrame
    name: str
    path: str
    key: str
    buckets: int

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` by hash of the key, to be joined with the table. It may have fewer buckets
        than an exchange has partitions, and then Spark would exchange the table as well."""
        if self.buckets >= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            return rows
        return rows.repartition(self.buckets, self.key)

    def removed(self) -> None:
        spark = self.rows.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        removed(spark, self.path)


def attached(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> Bucketed:
    """The table that ``bucketed`` has written at ``path``, in this or another session."""
    name = f"pageloom_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return Bucketed(spark.table(name), name, path, key, buckets)


def buckets_for(spark: SparkSession, rows: int) -> int:
    """How many buckets a table of about so many rows gets: each look-up opens all of them, so
    not more than the rows or the cores are worth, and one for each shuffle partition at most."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS)))


def bucketed(df: DataFrame, path: str, key: str, buckets: int | None = None) -> Bucketed:
    """Writes ``df`` in ``buckets`` sorted files (one for each shuffle partition)."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"pageloom_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    dealt.option("path", path).saveAsTable(name)
    return Bucketed(spark.table(name), name, path, key, buckets)


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a work table that nothing reads any more."""
    where, store = _store(spark, path)
    store.delete(where, True)


def folder_numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers N of the folders ``name=N`` below ``path``; empty if it is missing."""
    where, store = _store(spark, path)
    if not store.exists(where):
        return []
    names = [f.getPath().getName() for f in store.listStatus(where) if f.isDirectory()]
    return sorted(int(n.partition("=")[2]) for n in names if n.partition("=")[2].isdigit())
