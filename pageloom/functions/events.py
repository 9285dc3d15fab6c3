"""H0: HTML text to an ordered array of parse events.

This is the only Python in the plans. It turns markup into open / close /
text / raw events and notes facts that need the stack of open elements (which
event closes which, list nesting, cell numbers, ...). Every rule about what to
do with the events is a Column expression elsewhere.

Tree rules: no implied end tags; an end tag closes up to the nearest open
element of its name or is ignored; void elements close at once; what is still
open at the end is closed there; script and style hold raw text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The parser travels with its tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements that are clutter wherever they stand.
BOILERPLATE = ("nav", "aside", "script", "style", "header", "footer", "form", "img")

# Elements that never have content.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex "
    "keygen link menuitem meta nextid param source spacer track wbr".split()
)

# Elements that mark their text as stressed.
EMPHASIS = frozenset(("em", "i", "u", "strong", "b", "del", "strike", "s"))

EVENT = T.StructType(
    [
        T.StructField("i", T.IntegerType()),  # position in the array, from 0
        T.StructField("j", T.IntegerType()),  # position of the matching open / close
        T.StructField("kind", T.StringType()),  # o(pen) c(lose) t(ext) r(aw markup)
        T.StructField("tag", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("list_depth", T.IntegerType()),  # open ul/ol around it
        T.StructField("list_kind", T.StringType()),  # innermost of them
        T.StructField("n", T.IntegerType()),  # item, cell or cell-count number
        T.StructField("row", T.IntegerType()),  # table row number (on tr close)
        T.StructField("quote_depth", T.IntegerType()),  # open blockquotes around it
        T.StructField("pre_no", T.IntegerType()),  # number of a pre, from 0
        T.StructField("pre_depth", T.IntegerType()),  # open pre elements around it
        # of a text: 1 = first text since an emphasis tag opened, 2 = next text
        T.StructField("stress", T.IntegerType()),
        T.StructField("last_tag", T.StringType()),  # of a text after stress: tag before it
        T.StructField("in_link", T.BooleanType()),
        T.StructField("in_head", T.BooleanType()),
    ]
)
PARSED = T.StructType(
    [T.StructField("error", T.StringType()), T.StructField("events", T.ArrayType(EVENT))]
)
_ARROW = {
    T.IntegerType(): pa.int32(),
    T.StringType(): pa.string(),
    T.BooleanType(): pa.bool_(),
    T.MapType(T.StringType(), T.StringType()): pa.map_(pa.string(), pa.string()),
}
# Noncharacters that later steps use as marks; no valid text has them.
_MARKS = re.compile("[\ufdd0-\ufddf]")
_BLANK_WITH_BREAK = re.compile(r"[ \t\r\f\v]*\n[ \t\r\n\f\v]*")
_BLANK = re.compile(r"[ \t\r\n\f\v]+")
_NUMBER = re.compile(r"-?\d+\Z")


class _Tokens(HTMLParser):
    """html.parser with entities decoded.

    What is not closed before the end of a page is looked for once only: the
    tokenizer would search the rest of the page again at each such opening, and
    a page of a million of them would hold up its task for hours.
    """

    def __init__(self):
        super().__init__(convert_charrefs=False)

    def reset(self):
        super().reset()
        self.no_more_tags = self.no_more_comments = self.no_more_sections = False

    def updatepos(self, i, j):
        return j  # lines are not counted

    def _tag_never_ends(self, i):
        if not self.no_more_tags and self.rawdata.find(">", i) < 0:
            self.no_more_tags = True
        return self.no_more_tags

    def check_for_whole_start_tag(self, i):
        return -1 if self._tag_never_ends(i) else super().check_for_whole_start_tag(i)

    def parse_endtag(self, i):
        return -1 if self._tag_never_ends(i) else super().parse_endtag(i)

    def parse_pi(self, i):
        return -1 if self._tag_never_ends(i) else super().parse_pi(i)

    def parse_bogus_comment(self, i, report=1):
        return -1 if self._tag_never_ends(i) else super().parse_bogus_comment(i, report)

    def parse_comment(self, i, report=1):
        end = -1 if self.no_more_comments else super().parse_comment(i, report)
        self.no_more_comments = end < 0
        return end

    def parse_marked_section(self, i, report=1):
        end = -1 if self.no_more_sections else super().parse_marked_section(i, report)
        self.no_more_sections = end < 0
        return end

    def handle_charref(self, name):
        self.handle_data(unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self.handle_data(html5.get(name + ";") or "&" + name)


class _EventBuilder(_Tokens):
    """Collects the events of one page after another."""

    def __init__(self, skip: tuple[str, ...]):
        super().__init__()
        self.rows: list[tuple] = []  # all fields but j
        self.ends: list[int] = []  # j, which is known later for an open
        self.skip = frozenset(skip)

    def page(self, html: str) -> None:
        self.reset()
        self.start = len(self.rows)
        self.stack: list[tuple[str, int, dict]] = []
        self.open_count: dict[str, int] = {}
        self.pieces: list[str] = []
        self.skipping = 0
        self.lists: list[list] = []
        self.tables: list[list[int]] = []
        self.quotes = self.pres = self.links = self.pre_total = 0
        self.head = False
        self.stress = 0
        self.last_tag: str | None = None
        self.closed_voids: dict[str, int] = {}
        self.feed(_MARKS.sub("", html))
        self.close()
        self.flush()
        while self.stack:
            self.pop()

    def rollback(self) -> None:
        del self.rows[self.start :], self.ends[self.start :]

    def emit(self, kind, tag=None, text=None, attrs=(), j=None, n=None, row=None, pre_no=None, stress=0):
        here = len(self.rows) - self.start
        self.ends.append(here if j is None else j)
        self.rows.append(
            (
                here,
                kind,
                tag,
                text,
                attrs,
                len(self.lists),
                self.lists[-1][0] if self.lists else None,
                n,
                row,
                self.quotes,
                pre_no,
                self.pres,
                stress,
                self.last_tag if stress == 2 else None,
                self.links > 0,
                self.head,
            )
        )
        return here

    def columns(self) -> list:
        i, *rest = zip(*self.rows) if self.rows else [()] * (len(EVENT) - 1)
        return [i, self.ends, *rest]

    def flush(self) -> None:
        if not self.pieces:
            return
        text = "".join(self.pieces)
        self.pieces = []
        if self.skipping or not text:
            return
        if not self.pres and not self.open_count.get("textarea"):
            if _BLANK_WITH_BREAK.fullmatch(text):
                text = "\n"
            elif _BLANK.fullmatch(text):
                text = " "
        self.emit("t", text=text, stress=self.stress)
        self.stress = 2 if self.stress == 1 else 0

    def push(self, tag: str, attrs: dict) -> None:
        self.flush()
        self.open_count[tag] = self.open_count.get(tag, 0) + 1
        if self.skipping or tag in self.skip:
            self.skipping += 1
            self.stack.append((tag, -1, attrs))
            return
        n = pre_no = None
        self.last_tag = tag
        if tag in EMPHASIS:
            self.stress = 1
        if tag == "li" and self.lists:
            self.lists[-1][1] += 1
            n = self.lists[-1][1]
        elif tag in ("ul", "ol"):
            start = attrs.get("start") or ""
            first = int(start) - 1 if tag == "ol" and _NUMBER.match(start) else 0
            self.lists.append([tag, first])
        elif tag == "table":
            self.tables.append([0, 0])
        elif tag == "tr" and self.tables:
            self.tables[-1][1] = 0
        elif tag in ("td", "th") and self.tables:
            self.tables[-1][1] += 1
            n = self.tables[-1][1]
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "head":
            self.head = True
        elif tag == "body":
            self.head = False
        elif tag == "pre":
            pre_no = self.pre_total
            self.pre_total += 1
        where = self.emit("o", tag, attrs=tuple(attrs.items()), n=n, pre_no=pre_no)
        if tag == "pre":
            self.pres += 1
        elif tag == "a":
            self.links += 1
        self.stack.append((tag, where, attrs))

    def pop(self) -> None:
        tag, where, attrs = self.stack.pop()
        self.open_count[tag] -= 1
        if where < 0:
            self.skipping -= 1
            return
        n = row = None
        self.last_tag = tag
        if tag == "tr" and self.tables:
            self.tables[-1][0] += 1
            row, n = self.tables[-1]
        elif tag == "table":
            self.tables.pop()
        elif tag == "blockquote":
            self.quotes -= 1
        elif tag == "head":
            self.head = False
        elif tag == "pre":
            self.pres -= 1
        elif tag == "a":
            self.links -= 1
        kept = tuple(attrs.items()) if tag == "a" else ()
        here = self.emit("c", tag, attrs=kept, j=where, n=n, row=row)
        self.ends[self.start + where] = here
        if tag in ("ul", "ol"):
            self.lists.pop()

    def handle_starttag(self, tag, attrs):
        self.push(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self.pop()
            self.closed_voids[tag] = self.closed_voids.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.push(tag, {k: v or "" for k, v in attrs})
        self.pop()

    def handle_endtag(self, tag):
        if self.closed_voids.get(tag):
            self.closed_voids[tag] -= 1
            return
        self.flush()
        if not self.open_count.get(tag):
            return
        while True:
            top = self.stack[-1][0]
            self.pop()
            if top == tag:
                return

    def handle_data(self, data):
        self.pieces.append(data)

    def raw(self, markup: str) -> None:
        self.flush()
        if not self.skipping:
            self.emit("r", text=markup)

    def handle_comment(self, data):
        self.raw(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.raw(f"<!{decl}>")

    def unknown_decl(self, data):
        self.raw(f"<![{data}]>")

    def handle_pi(self, data):
        self.raw(f"<?{data}>")


# Events kept as Python objects before they are packed and sent, which bounds the memory
# of a worker however dense the markup of a batch is.
CHUNK = 20_000


def _packed(builder: _EventBuilder, errors: list, offsets: list[int]) -> pa.Array:
    fields = [
        pa.array(values, type=_ARROW[field.dataType])
        for values, field in zip(builder.columns(), EVENT)
    ]
    events = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, EVENT.names)
    )
    return pa.StructArray.from_arrays([pa.array(errors, pa.string()), events], PARSED.names)


def _parse_batch(pages: pa.Array, skip: tuple[str, ...]) -> Iterator[pa.Array]:
    """The pages of a batch in parts of about ``CHUNK`` events; none is held when the next is made."""
    builder, errors, offsets = _EventBuilder(skip), [], [0]
    for page in pages:
        html, error = page.as_py(), None
        if html is not None:
            try:
                builder.page(html)
            except Exception as bad:  # a page is data: report it, keep the task
                builder.rollback()
                error = f"{type(bad).__name__}: {bad}"
        errors.append(error)
        offsets.append(len(builder.rows))
        if offsets[-1] > CHUNK:
            part = _packed(builder, errors, offsets)
            builder, errors, offsets = _EventBuilder(skip), [], [0]
            yield part
            del part
    if errors:
        yield _packed(builder, errors, offsets)


def parse_events(html: Column, skip: tuple[str, ...] = BOILERPLATE) -> Column:
    """``struct<error, events>`` of a page; subtrees of ``skip`` are left out (H1).

    Leaving clutter out here keeps menus, scripts and styles, most of the bytes
    of a page, from crossing back into the JVM. ``skip=()`` gives all events.

    The function is declared nondeterministic, although it is not, so that a
    filter on its result is not moved below it and pages parsed twice.
    """

    @F.arrow_udf(returnType=PARSED)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield from _parse_batch(pages, skip)

    return parse.asNondeterministic()(html)


LINKS = T.StructType(
    [
        T.StructField("refresh", T.StringType()),  # content of the refresh tag
        T.StructField("hrefs", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),  # why the links could not be read
    ]
)


class _LinkReader(_Tokens):
    """Hrefs and the refresh tag only: needs no tree, ships few bytes."""

    def page(self, html: str):
        self.reset()
        self.hrefs: list[str | None] = []
        self.refresh = None
        self.feed(html)
        self.close()
        return self.refresh, self.hrefs

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.hrefs.append(dict(attrs).get("href"))
        elif tag == "meta" and self.refresh is None:
            values = dict(attrs)
            if "refresh" in (values.get("http-equiv") or "").lower():
                self.refresh = values.get("content") or ""


def _links_of(pages: pa.Array) -> pa.Array:
    reader = _LinkReader()
    found = []
    for page in pages:
        try:
            found.append((*reader.page(page.as_py() or ""), None))
        except Exception as bad:  # a page is data: report it, keep the task
            found.append((None, [], f"{type(bad).__name__}: {bad}"))
    return pa.StructArray.from_arrays(
        [
            pa.array([r for r, _, _ in found], pa.string()),
            pa.array([h for _, h, _ in found], pa.list_(pa.string())),
            pa.array([e for _, _, e in found], pa.string()),
        ],
        LINKS.names,
    )


def parse_links(html: Column) -> Column:
    """``struct<refresh, hrefs, error>`` of a page as written, boilerplate included, in
    document order. Nondeterministic for the reason given above."""

    @F.arrow_udf(returnType=LINKS)
    def parse(pages: pa.Array) -> pa.Array:
        return _links_of(pages)

    return parse.asNondeterministic()(html)
