"""K1 as files: one file per page under a folder that mirrors the URLs, published whole.

A data source that commits in two phases. Tasks write below ``_staged/RUN`` of the root, each
file under a name of its own attempt first and then moved to its place, so retried and
doubled attempts leave the same whole file. When all tasks have ended, the driver moves the
staged tree to ``version=N`` in one step and writes the manifest ``_published/version=N.json``;
if one has failed for good, it deletes what was staged. What has no manifest is not listed.

The root is a folder all nodes see: a local or mounted path, or any address that pyarrow
opens, whose store moves folders (a file system, not a plain object store).
"""

from __future__ import annotations

import json
import posixpath
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "pageloom_tree"


def _store(root: str) -> tuple[fs.FileSystem, str]:
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class TreeSink(DataSource):
    """Rows of ``domain, out_path, content``; options ``path`` and ``version``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"domain", "out_path", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"the tree needs the columns {sorted(missing)}")
        return TreeWriter(self.options["path"], int(self.options["version"]), overwrite)


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str, version: int, overwrite: bool):
        self.root, self.version, self.overwrite = root.rstrip("/"), version, overwrite
        self.run = uuid.uuid4().hex

    def _place(self, base: str, *names: str) -> str:
        """A path below ``base``; names that would leave it are refused."""
        path = posixpath.normpath(posixpath.join(base, *names))
        if not path.startswith(base + "/"):
            raise ValueError(f"{posixpath.join(*names)} is not below the tree")
        return path

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.root)
        staged, attempt, made = f"{root}/_staged/{self.run}", uuid.uuid4().hex, set()
        parts = f"{staged}/parts/{attempt}"
        store.create_dir(parts, recursive=True)
        files = size = 0
        for row in iterator:
            target = self._place(f"{staged}/tree", row["domain"], row["out_path"])
            folder = posixpath.dirname(target)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            data = (row["content"] or "").encode()
            part = f"{parts}/{files}"
            with store.open_output_stream(part, compression=None) as out:
                out.write(data)
            store.move(part, target)
            files += 1
            size += len(data)
        return Written(files, size)

    def commit(self, messages: list) -> None:
        store, root = _store(self.root)
        staged, place = f"{root}/_staged/{self.run}", f"{root}/version={self.version}"
        manifest = f"{root}/_published/version={self.version}.json"
        store.create_dir(f"{staged}/tree", recursive=True)
        store.create_dir(f"{root}/_published", recursive=True)
        if store.get_file_info(manifest).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise ValueError(f"version {self.version} is published already")
            store.delete_file(manifest)
        if store.get_file_info(place).type != fs.FileType.NotFound:  # replaced, or never published
            store.delete_dir(place)
        store.move(f"{staged}/tree", place)
        done = [m for m in messages if m is not None]
        told = {"version": self.version, "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}
        with store.open_output_stream(f"{manifest}.part", compression=None) as out:
            out.write(json.dumps(told).encode())
        store.move(f"{manifest}.part", manifest)
        store.delete_dir(staged)

    def abort(self, messages: list) -> None:
        store, root = _store(self.root)
        staged = f"{root}/_staged/{self.run}"
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


def write_tree(export: DataFrame, root: str, version: int = 0, overwrite: bool = True) -> None:
    """Publishes an export as the tree ``root/version=N/domain/out_path``."""
    export.sparkSession.dataSource.register(TreeSink)
    rows = export.select("domain", "out_path", "content")
    mode = "overwrite" if overwrite else "append"
    rows.write.format(FORMAT).mode(mode).option("path", root).option("version", str(version)).save()


def published(root: str) -> list[dict]:
    """``version``, ``files`` and ``bytes`` of each published tree, in order."""
    store, path = _store(root.rstrip("/"))
    listed = store.get_file_info(fs.FileSelector(f"{path}/_published", allow_not_found=True))
    out = []
    for file in listed:
        if file.path.endswith(".json"):
            with store.open_input_file(file.path) as source:
                out.append(json.loads(source.read()))
    return sorted(out, key=lambda m: m["version"])


def read_tree(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """``domain, out_path, content`` of a published tree, by default the last."""
    numbers = [m["version"] for m in published(root)]
    if version is None and numbers:
        version = numbers[-1]
    if version not in numbers:
        raise ValueError(f"no version {version}; there are {numbers}")
    base = f"{root.rstrip('/')}/version={version}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    return files.selectExpr(
        f"regexp_extract(path, '/version={version}/([^/]+)/(.+)$', 1) AS domain",
        f"regexp_extract(path, '/version={version}/([^/]+)/(.+)$', 2) AS out_path",
        "decode(content, 'UTF-8') AS content",
    )
