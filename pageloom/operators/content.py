"""H2-H5, H19, H20 and the assembly of a page's content record.

Everything works on the events of one page, so there is no shuffle here. Main
content and title are found by filters over the array; the output texts are
maps over the same events joined to a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.core import let, one_blank, over, strip_ws
from pageloom.functions.events import BOILERPLATE, PARSED, VOID, parse_events, parse_links
from pageloom.functions.marks import LINE
from pageloom.functions.urls import normalize_url
from pageloom.operators.code import class_list, code_blocks
from pageloom.operators.markdown import markdown_text

CONTENT_FIELDS = ("title", "markdown", "html_cleaned", "plain_text", "code_blocks")

# Class names of main containers, in order of preference.
MAIN_CLASSES = ("content", "document", "theme-default-content")

# Elements that stand on lines of their own in plain text.
BLOCKS = (
    "address article blockquote body br dd details div dl dt fieldset figcaption figure "
    "h1 h2 h3 h4 h5 h6 hr li main ol p pre section table tr ul"
).split()

# Attributes whose value is a list of tokens, written with single blanks.
TOKEN_LISTS = ("class", "rel", "rev", "accesskey", "dropzone")


def main_rank(event: Column) -> Column:
    """H2: rank of an element as main container, NULL if it is none."""
    classes = class_list(event.attrs)
    rank = F.when(event.tag == "main", 1).when(event.tag == "article", 2)
    by_class = F.lit(None)
    for at, name in reversed(list(enumerate(MAIN_CLASSES, start=3))):
        by_class = F.when(F.array_contains(classes, name), at).otherwise(by_class)
    # Fixed value: ids that mark a main container.
    by_id = F.when(
        F.try_element_at(event.attrs, F.lit("id")).rlike("(?i)^(?:content|main)"),
        3 + len(MAIN_CLASSES),
    )
    rank = rank.when(event.tag == "div", F.coalesce(by_class, by_id))
    return rank.when(event.tag == "body", 4 + len(MAIN_CLASSES))


def select_main(events: Column) -> Column:
    """H2: ``struct<rank,i,j>`` of the main container, NULL if there is none."""
    ranked = F.transform(
        F.filter(
            events,
            lambda e: (e.kind == "o") & e.tag.isin("main", "article", "div", "body"),
        ),
        lambda e: F.struct(main_rank(e).alias("rank"), e.i.alias("i"), e.j.alias("j")),
    )
    return F.array_min(F.filter(ranked, lambda m: m["rank"].isNotNull()))


def title_of(events: Column) -> Column:
    """H3: stripped text of the first title if it is a single string."""

    def text(title: Column) -> Column:
        inside = F.slice(events, title.i + 2, title.j - title.i - 1)
        return let(
            inside,
            lambda part: F.when(
                F.array_join(F.transform(part, lambda e: e.kind), "").rlike("^o*[tr]c*$"),
                strip_ws(F.get(F.filter(part, lambda e: e.kind.isin("t", "r")), F.lit(0)).text),
            ),
        )

    first = F.get(
        F.filter(events, lambda e: (e.kind == "o") & (e.tag == "title")), F.lit(0)
    )
    return F.coalesce(let(first, lambda t: F.when(t.isNotNull(), text(t))), F.lit(""))


def _escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _attribute(name: Column, value: Column) -> Column:
    tokens = F.trim(F.regexp_replace(value, r"\s+", " "))
    shown = _escaped(F.when(name.isin(*TOKEN_LISTS), tokens).otherwise(value))
    quoted = (
        F.when(~shown.contains('"'), F.concat(F.lit('"'), shown, F.lit('"')))
        .when(~shown.contains("'"), F.concat(F.lit("'"), shown, F.lit("'")))
        .otherwise(
            F.concat(F.lit('"'), F.replace(shown, F.lit('"'), F.lit("&quot;")), F.lit('"'))
        )
    )
    return F.concat(F.lit(" "), name, F.lit("="), quoted)


def cleaned_html(body: Column) -> Column:
    """The main container as HTML, code left as it is."""

    def markup(e: Column) -> Column:
        void = e.tag.isin(*sorted(VOID))
        attrs = F.array_join(
            F.transform(F.map_entries(e.attrs), lambda a: _attribute(a.key, a.value)), ""
        )
        return (
            F.when(e.kind == "t", _escaped(e.text))
            .when(e.kind == "r", e.text)
            .when(
                e.kind == "o",
                F.concat(
                    F.lit("<"), e.tag, attrs, F.when(void, F.lit("/>")).otherwise(F.lit(">"))
                ),
            )
            .when(void, F.lit(""))
            .otherwise(F.concat(F.lit("</"), e.tag, F.lit(">")))
        )

    return F.array_join(F.transform(body, markup), "")


def plain_text(body: Column) -> Column:
    """Text without markup; blocks on lines of their own, code as it is."""

    def part(e: Column) -> Column:
        flowing = one_blank(e.text)
        return (
            F.when(e.in_head, F.lit(""))
            .when(
                e.kind == "t",
                F.when((e.pre_depth > 0), e.text).otherwise(flowing),
            )
            .when(e.kind.isin("o", "c") & e.tag.isin(*BLOCKS), F.lit(LINE))
            .when((e.kind == "c") & e.tag.isin("td", "th"), F.lit(" "))
            .otherwise(F.lit(""))
        )

    joined = F.array_join(F.transform(body, part), "")
    lines = F.regexp_replace(joined, rf"[ ]*+{LINE}[ {LINE}]*+", "\n")
    return F.trim(lines, F.lit(" \n"))


def content_record(events: Column, fields=CONTENT_FIELDS) -> Column:
    """The asked fields of a page's content as one struct, each rule run once."""

    def built(main: Column, body: Column) -> Column:
        def with_blocks(blocks: Column) -> Column:
            parts = {
                "title": lambda: title_of(events),
                "markdown": lambda: markdown_text(body, blocks),
                "html_cleaned": lambda: F.when(
                    main.isNotNull(), cleaned_html(body)
                ).otherwise(F.lit("")),
                "plain_text": lambda: plain_text(body),
                "code_blocks": lambda: F.transform(
                    blocks,
                    lambda b, k: F.struct(
                        k.alias("block_no"), b.lang.alias("lang"), b.code.alias("code")
                    ),
                ),
            }
            return F.struct(*[parts[f]().alias(f) for f in fields])

        if {"markdown", "code_blocks"} & set(fields):
            return let(code_blocks(events, body), with_blocks)
        return with_blocks(None)

    def sliced(main: Column) -> Column:
        body = F.when(
            main.isNotNull(), F.slice(events, main.i + 1, main.j - main.i + 1)
        ).otherwise(events)
        return let(body, lambda b: built(main, b))

    if tuple(fields) == ("title",):
        return F.struct(title_of(events).alias("title"))
    return let(select_main(events), sliced)


def _content_of(parsed: Column, fields: tuple[str, ...]) -> Column:
    none = F.array().cast(PARSED["events"].dataType)
    return let(
        F.coalesce(parsed.events, none), lambda events: content_record(events, fields)
    )


def extract_content(
    pages: DataFrame, fields: tuple[str, ...] = CONTENT_FIELDS, html: str = "html"
) -> DataFrame:
    """Replace ``html`` by the asked content fields and an ``error`` column.

    The always-true test on the row id keeps the optimizer from copying the whole
    extraction into a filter on one of its fields and running it twice. Streams
    have no such ids.
    """
    kept = [c for c in pages.columns if c != html]
    content = over(_content_of, "_parsed", fields=tuple(fields))
    if not pages.isStreaming:
        content = F.when(F.monotonically_increasing_id() >= 0, content)
    return (
        pages.select(*kept, parse_events(F.col(html), BOILERPLATE).alias("_parsed"))
        .select(
            *kept,
            content.alias("_content"),
            F.col("_parsed.error").alias("error"),
        )
        .select(*kept, *[f"_content.{f}" for f in fields], "error")
    )


def refresh_target(content: Column) -> Column:
    """H5: target named by the content of a refresh tag, NULL if none."""
    # Fixed value: where a refresh tag names its target.
    found = F.regexp_extract(content, r"(?i)url=([^;\"']+)", 1)
    return let(strip_ws(found), lambda t: F.when(t != "", t))


def queue_hrefs(links: Column) -> Column:
    """O1: the refresh target, or NULL, followed by the anchors' hrefs."""
    return F.concat(F.array(refresh_target(links.refresh)), links.hrefs)


def link_targets(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """H4, H5, O1: one row per link as ``pos, href, target``.

    ``pos`` orders the links of a page as the queue takes them: the refresh tag
    is 0, then the anchors from 1. ``target`` is the normalised URL, or NULL.
    """
    found = pages.select(*keep, parse_links(F.col("html")).alias("_links"))
    return (
        found.select(*keep, F.posexplode(over(queue_hrefs, "_links")).alias("pos", "href"))
        .filter(F.col("href").isNotNull())
        .withColumn("target", over(normalize_url, "url", "href"))
    )
