"""Markdown from parse events.

Each event becomes a token; tokens carry marks for what is pending (a blank
line, a line, a blank that may be dropped). A short list of linear regex passes
over the joined text then settles the white space, and the code blocks, kept
out of those passes, come back last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.core import SPACES, WS, let, one_blank, strip_ws, where_has
from pageloom.functions.marks import (
    BREAK,
    CODE,
    CODE_END,
    GLUE,
    HEADING,
    HEADING_END,
    LINE,
    PARA,
    QUOTE,
    QUOTE_END,
    ROW,
    SPACE,
    START,
)
from pageloom.functions.text import after_fences, before_fences
from pageloom.operators.code import fence

HEADINGS = {f"h{n}": "#" * n for n in range(1, 7)}
STRESS_MARKS = {
    **dict.fromkeys(("em", "i", "u"), "_"),
    **dict.fromkeys(("strong", "b"), "**"),
    **dict.fromkeys(("del", "strike", "s"), "~~"),
}
CODE_TAGS = ("code", "tt", "kbd")


def escape_data(text: Column) -> Column:
    """Escape what would start a list or an escape sequence in Markdown.

    ``& < >`` begin a fresh piece of text, as they are entities in the source.
    """

    def guarded(t: Column) -> Column:
        line_start = r"(?md)(^|(?<=[&<>]))"
        escaped = F.regexp_replace(t, r"(\\)(?=[\\`*_{}\[\]()#+\-.!])", r"\\\\")
        escaped = F.regexp_replace(
            escaped, rf"{line_start}({WS}*+\p{{Nd}}+)(\.)(?={WS})", r"$1$2\\."
        )
        escaped = F.regexp_replace(escaped, rf"{line_start}({WS}*+)(\+)(?={WS})", r"$1$2\\+")
        escaped = F.regexp_replace(
            escaped, rf"{line_start}({WS}*+)(-)(?=[-{SPACES}])", r"$1$2\\-"
        )
        suspect = t.rlike(r"[\\&<>\n]") | t.rlike(rf"^{WS}*+(?:\p{{Nd}}++\.|[+-])")
        return F.when(suspect, escaped).otherwise(t)

    return let(text, guarded)


def _escape_target(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]()])", r"\\$1")


def _link_end(attrs: Column) -> Column:
    title = F.coalesce(F.try_element_at(attrs, F.lit("title")), F.lit(""))
    return F.concat(
        F.lit(GLUE + "]("),
        _escape_target(F.element_at(attrs, "href")),
        F.when(
            F.trim(title) != "",
            F.concat(F.lit(' "'), _escape_target(title), F.lit('"')),
        ).otherwise(""),
        F.lit(")"),
    )


def _opening(e: Column) -> Column:
    item = F.when(e.list_kind == "ol", F.concat(e.n.cast("string"), F.lit("."))).otherwise("*")
    href = F.try_element_at(e.attrs, F.lit("href"))
    case = F.when(
        e.tag.isin("p", "div"), F.when(e.in_link, F.lit("")).otherwise(F.lit(PARA))
    )
    for tag, marks in HEADINGS.items():
        within_link = F.lit(HEADING + marks + HEADING_END)
        case = case.when(
            e.tag == tag,
            F.when(e.in_link, within_link).otherwise(F.lit(PARA + marks + SPACE + START)),
        )
    for mark in sorted(set(STRESS_MARKS.values())):
        tags = [t for t, m in STRESS_MARKS.items() if m == mark]
        case = case.when(e.tag.isin(*tags), F.lit(mark))
    return (
        case.when(e.tag.isin(*CODE_TAGS), F.lit("`"))
        .when(e.tag == "a", F.when(href.isNotNull() & ~href.startswith("#"), F.lit("[")))
        .when(e.tag == "br", F.lit(BREAK))
        .when(e.tag == "hr", F.lit(f"{PARA}* * *{PARA}"))
        .when(
            e.tag.isin("ul", "ol"),
            F.when(e.list_depth == 1, F.lit(PARA)).otherwise(F.lit("")),
        )
        .when(
            e.tag == "li",
            F.concat(
                F.lit(LINE),
                F.repeat(F.lit(SPACE * 2), e.list_depth),
                item,
                F.lit(SPACE + START),
            ),
        )
        .when(
            e.tag == "blockquote",
            F.concat(
                F.lit(PARA + QUOTE),
                e.quote_depth.cast("string"),
                F.lit(f"{QUOTE_END}>{SPACE}{START}"),
            ),
        )
        .when(e.tag == "q", F.lit('"'))
        .when(e.tag == "dl", F.lit(PARA))
        .when(e.tag == "dd", F.lit(SPACE * 4))
        .when(e.tag.isin("td", "th") & (e.n > 1), F.lit("| "))
        .when(
            e.tag == "pre", F.concat(F.lit(CODE), e.pre_no.cast("string"), F.lit(CODE_END))
        )
    )


def _closing(e: Column) -> Column:
    href = F.try_element_at(e.attrs, F.lit("href"))
    case = F.when(
        e.tag.isin("p", "div"), F.when(e.in_link, F.lit("")).otherwise(F.lit(PARA))
    ).when(e.tag.isin(*HEADINGS), F.when(e.in_link, F.lit("")).otherwise(F.lit(PARA)))
    for mark in sorted(set(STRESS_MARKS.values())):
        tags = [t for t, m in STRESS_MARKS.items() if m == mark]
        case = case.when(e.tag.isin(*tags), F.lit(mark))
    underline = F.concat(
        F.lit(ROW), F.array_join(F.array_repeat(F.lit("---"), e.n), "|"), F.lit(ROW)
    )
    return (
        case.when(e.tag.isin(*CODE_TAGS), F.lit("`"))
        .when(
            e.tag == "a",
            F.when(href.isNotNull() & ~href.startswith("#"), _link_end(e.attrs)),
        )
        .when(
            e.tag.isin("ul", "ol"),
            F.when(e.list_depth == 1, F.lit(PARA)).otherwise(F.lit("")),
        )
        .when(e.tag.isin("li", "dt", "dd"), F.lit(LINE))
        .when(
            e.tag == "blockquote",
            F.concat(
                F.lit(QUOTE), e.quote_depth.cast("string"), F.lit(QUOTE_END + PARA)
            ),
        )
        .when(e.tag == "q", F.lit('"'))
        .when(e.tag == "tr", F.when(e["row"] == 1, underline).otherwise(F.lit(ROW)))
    )


def _text(e: Column) -> Column:
    """A text node. Stressed text is stripped, as its marks must touch it; a
    word that follows stressed text in the same line gets a blank."""
    text = e.text
    follows = text.rlike(rf"^[^\]\[(){{}}{SPACES}.!?]") & ~e.last_tag.isin("a", "code", "pre")
    return escape_data(
        F.when(e.stress == 1, strip_ws(text))
        .when((e.stress == 2) & follows, F.concat(F.lit(" "), text))
        .otherwise(text)
    )


def _token(e: Column) -> Column:
    return F.coalesce(
        F.when((e.pre_depth > 0) | e.in_head | (e.kind == "r"), F.lit(""))
        .when(e.kind == "t", _text(e))
        .when(e.kind == "o", _opening(e))
        .otherwise(_closing(e)),
        F.lit(""),
    )


def _settle(joined: Column) -> Column:
    """Turn pending marks into white space. Every pass is linear in the text
    and starts from a mark, and passes for marks a text lacks are skipped."""
    pending = f"{PARA}{LINE}{ROW}"

    def passes(*pairs: tuple[str, str]):
        def run(t: Column) -> Column:
            for pattern, replacement in pairs:
                t = F.regexp_replace(t, pattern, replacement)
            return t

        return run

    text = one_blank(F.concat(F.lit(START), joined))
    text = where_has(
        text,
        (GLUE,),
        passes(
            # a link whose text is its target
            (rf"\[([a-zA-Z+]+://[^\]{GLUE}]*+){GLUE}\]\(\1\)", "<$1>"),
            (rf"[{pending}][ {pending}]*+{GLUE}", ""),
            (GLUE, ""),
        ),
    )
    text = where_has(
        text,
        (HEADING,),
        passes(
            # a heading that begins a link begins before it; another has no sign
            (rf"\[ ?{HEADING}(#++){HEADING_END}", f"$1{SPACE}["),
            (rf"{HEADING}#++{HEADING_END}", ""),
        ),
    )
    text = F.regexp_replace(text, rf"{START}[ {pending}{START}]*+", "")
    for mark in (PARA, LINE, ROW, BREAK, QUOTE):
        text = F.replace(text, F.lit(f" {mark}"), F.lit(mark))
    text = where_has(
        text,
        (QUOTE,),
        # leaving a quote: what is pending belongs to the outer text
        passes((rf"[{pending}][ {pending}]*+({QUOTE}\d+{QUOTE_END}{PARA})", "$1")),
    )
    text = where_has(text, (LINE, ROW), passes((rf"[{LINE}{ROW}]++(?={PARA})", "")))
    text = F.regexp_replace(text, rf"{PARA}[ {pending}]*+", "\n\n")
    text = where_has(text, (ROW,), passes((rf"{LINE}*+{ROW}[ {LINE}{ROW}]*+", f"{SPACE}{SPACE}\n")))
    text = where_has(text, (LINE,), passes((rf"{LINE}[ {LINE}]*+", "\n")))
    text = F.replace(text, F.lit(f"{BREAK} "), F.lit(BREAK))
    text = F.replace(text, F.lit(BREAK), F.lit(f"{SPACE}{SPACE}\n"))
    return where_has(F.rtrim(text, F.lit(f" \n{SPACE}")), (QUOTE,), _quote_lines)


def _quote_lines(text: Column) -> Column:
    """Begin every line within a quote with as many ``>`` as it is deep."""

    def prefixed(part: Column) -> Column:
        pair = F.split(part, QUOTE_END)
        depth = F.when(F.size(pair) > 1, pair[0].cast("int")).otherwise(0)
        return let(
            depth,
            lambda d: F.replace(
                F.element_at(pair, -1),
                F.lit("\n"),
                F.when(d > 0, F.concat(F.lit("\n"), F.repeat(F.lit(">"), d), F.lit(SPACE))).otherwise(F.lit("\n")),
            ),
        )

    return F.array_join(F.transform(F.split(text, QUOTE), prefixed), "")


def restore_fences(text: Column, blocks: Column) -> Column:
    """Put the fence of each block where its number stands.

    One split and one lookup by position per block, so a page with thousands
    of blocks stays linear. The number is terminated, so 1 is never part of 10.
    """
    first = F.get(blocks, F.lit(0)).pre_no

    def part(piece: Column, at: Column) -> Column:
        block = F.get(blocks, piece.cast("int") - first)
        return F.when(at % 2 == 1, fence(block.lang, block.code)).otherwise(piece)

    def restored(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, f"[{CODE}{CODE_END}]"), part), "")

    return where_has(text, (CODE,), restored)


def markdown_text(body: Column, blocks: Column) -> Column:
    """H11-H18 over the events of the main container."""
    joined = F.array_join(F.transform(body, _token), "")
    settled = F.concat(
        F.replace(_settle(joined), F.lit(SPACE), F.lit(" ")), F.lit("\n")
    )
    return after_fences(restore_fences(before_fences(settled), blocks))
