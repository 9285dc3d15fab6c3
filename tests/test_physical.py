"""What the plans must and must not hold."""

import re

import pytest
from conftest import SF

import catalogue

# Queries that look at the HTML itself; all others must not read it.
READS_HTML = {
    "parse_events", "title", "links", "distinct_urls", "meta_refresh", "select_main_text",
    "cleaned_html", "markdown", "code_blocks", "markdown_fences", "render_txt", "normalize_url",
    "content_sha1", "diff_status", "diff_skip", "crawl_dedup", "first_seen", "markdown_export",
    "raw_html_sidecar",
}
# Queries whose result is read back from tables they have written.
WRITTEN = {
    "bfs_depth", "crawl_filters", "crawl_rules", "crawl_max_pages", "harvest_routes", "crawl_shared", "crawl_waves", "page_number",
    "export_versions", "export_log", "crawl_seen_filter", "stream_newest",
    "domain_partition", "export_tree", "previous_export", "stream_dedup", "stream_diff_export",
}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - WRITTEN))
def test_plan(spark, name):
    plan = _plan(catalogue.QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "RDDScan"):
        assert bad not in plan
    assert ("html:string" in plan) == (name in READS_HTML)
    assert plan.count("ArrowEvalPython [") <= 1


def test_pages_are_parsed_once_for_all_fields(spark):
    from pageloom.operators.content import extract_content

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plan = _plan(extract_content(pages))
    assert plan.count("ArrowEvalPython [") == 1 and "Exchange" not in plan


def test_filters_on_content_do_not_repeat_the_extraction(spark):
    from pageloom.operators.content import extract_content

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plan = _plan(extract_content(pages).filter("title <> '' AND size(code_blocks) > 0"))
    assert plan.count("array_min(") == 1 and plan.count("ArrowEvalPython [") == 1


def test_exports_parse_needed_pages_once(spark):
    plan = _plan(catalogue.QUERIES["markdown_export"](spark, SF))
    # the semi-join on ids stands below the parser, the join with paths above it
    assert plan.count("ArrowEvalPython [") == 1
    parser = plan.index("ArrowEvalPython")
    assert plan.index("LeftSemi") > parser and "Inner" in plan[:parser]


def _above(plan: str, scan: str, top: str) -> list[str]:
    """The nodes from the one named ``top`` down to the scan that reads ``scan``."""
    lines = [line for line in plan.splitlines() if re.search(r"\w", line)]
    at = next(i for i, line in enumerate(lines) if "Scan" in line and scan in line)
    depth = lambda line: re.search(r"[A-Za-z*(]", line).start()
    chain = [lines[at]]
    for line in reversed(lines[:at]):
        if depth(line) < depth(chain[-1]):
            chain.append(line)
            if top in line:
                return chain
    raise AssertionError(f"no {top} above the scan of {scan}")


def test_exports_leave_html_where_it_is_scanned(spark):
    from catalogue.harvest_queries import _saved
    from pageloom.config import HarvestConfig
    from pageloom.plans.export import export_rows, raw_html_rows

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    export = export_rows(_saved(spark, SF), pages, HarvestConfig(), date=None)
    export.collect()
    chain = "\n".join(_above(_plan(export), "html:string", "ArrowEvalPython"))
    assert "BroadcastHashJoin" in chain and "Exchange" not in chain
    raw = raw_html_rows(_saved(spark, SF), pages)
    raw.collect()
    assert "Exchange" not in "\n".join(_above(_plan(raw), "html:string", "BroadcastHashJoin"))


def test_levels_read_the_link_index_without_an_exchange(spark):
    from catalogue.inputs import graph_pages, graph_seeds
    from pageloom.config import HarvestConfig
    from pageloom.plans.crawl import _reader, first_frontier, level_pages, link_index
    from pageloom.session import work_dir

    index = link_index(graph_pages(spark, SF), graph_seeds(spark, SF), work_dir(spark))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large level
    try:
        frontier = first_frontier(graph_seeds(spark, SF))
        level = level_pages(frontier, None, _reader(index.rows, None), None, HarvestConfig())
        assert level.count() == 5
        reach = ("https://s0", "https://s1")
        plan = _plan(level_pages(frontier, None, _reader(index.rows, reach), None, HarvestConfig()))
        chain = _above(plan, "targets:array", "SortMergeJoin [url")
        assert "Bucketed: true" in chain[0] and "GreaterThanOrEqual(url" in chain[0]
        assert "Exchange" not in "\n".join(chain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        index.removed()


def test_a_level_opens_few_buckets_of_a_small_index(spark):
    """As many as the cores, not as the partitions of an exchange; and the index still stays where it is."""
    from pageloom.config import HarvestConfig
    from pageloom.plans.crawl import _reader, first_frontier, level_pages, link_index
    from pageloom.session import work_dir

    rows = [(i, f"https://h/{i or ''}", f'<a href="/{i + 1}">n</a>{i}') for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    seeds = spark.createDataFrame([(0, "https://h/")], "seed_id bigint, seed string")
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        index = link_index(pages, seeds, work_dir(spark))
        assert len(index.rows.inputFiles()) <= spark.sparkContext.defaultParallelism
        level = level_pages(first_frontier(seeds), None, _reader(index, None), None, HarvestConfig())
        assert [r.page_id for r in level.collect()] == [0]
        chain = _above(_plan(level), "targets:array", "SortMergeJoin [url")
        assert "Bucketed: true" in chain[0] and "Exchange" not in "\n".join(chain)
        index.removed()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sitemaps_are_parsed_once(spark):
    from catalogue.inputs import sitemaps
    from pageloom.sources.sitemaps import listed_urls

    assert "from_xml" not in _plan(listed_urls(sitemaps(spark, SF)))


def test_filters_on_stored_columns_reach_the_scan(spark):
    plan = _plan(catalogue.QUERIES["include_exclude"](spark, SF))
    assert "Exchange" not in plan and "ReadSchema: struct<page_id:bigint,url:string>" in plan
