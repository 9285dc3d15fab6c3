"""Archives: exact round trips, seek tables, single records."""

import base64
import hashlib
import os

import zstandard
from conftest import SF
from oracle import compare, connect
from pyspark.sql import functions as F

from pageloom.llm.queries import ORACLES, QUERIES
from pageloom.llm.warc import fetch_records, parse_record, read_archive, write_archive

ROWS = [
    (1, "https://a.example/", "<p>one</p>"),
    (2, "https://a.example/2", "<p>one</p>"),
    (3, "https://é.example/\r\nX: y", "ünïcode \r\n\r\n WARC/1.1 inside"),
    (4, None, None),
    (5, "https://a.example/5", ""),
    (6, "https://a.example/6", "x" * 400_000),
    (7, "https://a.example/7", "<p>one</p>"),
    (7, "https://a.example/7", "<p>one</p>"),
    (None, "https://a.example/n", "<p>one</p>"),
    (None, "https://a.example/n2", "only without id"),
]
SCHEMA = "page_id long, url string, html string, payload string, same int"


def archive(spark, rows=ROWS, **options):
    return write_archive(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), **options)


def expected(rows, least):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, other in rows if (other or "") == (html or "") and j is not None]
        refers = min(ids) if ids and len(data) >= least and min(ids) != i else None
        sha1 = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), sha1, "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def summary(records):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted(map(tuple, records.select(names).collect()), key=repr)


def test_round_trip(spark):
    for least in (0, 5, 1_000):
        found = archive(spark, revisit_from=least, frame_bytes=300, bundle_bytes=500)
        assert summary(read_archive(found)) == expected(ROWS, least)
    payloads = {r.page_id: bytes(r.payload) for r in read_archive(found).filter("page_id in (3, 6)").collect()}
    assert payloads == {3: ROWS[2][2].encode(), 6: ROWS[5][2].encode()}


def test_any_decompressor_reads_a_bundle(spark):
    found = archive(spark, frame_bytes=200)
    folder = f"{found.folder}/bundles".removeprefix("file:")
    records = 0
    for name in os.listdir(folder):
        with open(f"{folder}/{name}", "rb") as file:
            reader = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True)
            data, at = reader.read(), 0
        while at < len(data):
            _, at = parse_record(data, at)
            records += 1
    assert records == len(ROWS)


def test_single_records(spark):
    found = archive(spark, frame_bytes=100)
    index = found.index.filter("page_id in (2, 6)")
    got = fetch_records(found, index).select("page_id", F.length("payload").alias("n"), "refers_to")
    assert sorted(map(tuple, got.collect())) == [(2, None, 1), (6, 400_000, None)]
    assert fetch_records(found, index.filter("false")).count() == 0


def test_bundles_are_read_by_many_tasks(spark):
    rows = [(i, f"https://a.example/{i}", f"<p>{i}</p>" * 50) for i in range(100)]
    found = archive(spark, rows, frame_bytes=1, bundle_bytes=1)
    assert found.index.select("bundle").distinct().count() == 100
    records = read_archive(found)
    by_task = records.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 30 and max(r["count"] for r in by_task) < 20
    assert summary(records) == expected(rows, 0)
    some = fetch_records(found, found.index.filter("page_id % 3 = 0"))
    assert sorted(r.page_id for r in some.collect()) == list(range(0, 100, 3))


def test_folders_with_and_without_scheme(spark, tmp_path):
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/named"):
        found = archive(spark, folder=folder)
        assert found.folder.startswith("file:")
        assert summary(read_archive(found)) == expected(ROWS, 0)
        assert os.listdir(folder.removeprefix("file://") + "/bundles")


def test_empty_table(spark):
    assert read_archive(archive(spark, [])).count() == 0


def test_oracle(spark):
    name = "op10_warc"
    assert compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name]) is None
