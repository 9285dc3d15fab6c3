"""Code blocks of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.core import SPACES, let, rstrip_ws
from pageloom.functions.text import FENCE

# Class names taken as a language without a prefix.
KNOWN_LANGS = ("bash", "shell", "sh", "nix", "json", "yaml", "toml", "python", "js", "ts")
# The class prefix of a language, line ends, and the characters of which a
# line of a file tree consists.
LANG_PREFIX = "language-"

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_TREE = r"│└├┬─›>•·`~\\/|:_\-"

# A noncharacter that stands before every line while a block is cleaned.
_LINE = "\ufdd1"


def class_list(attrs: Column) -> Column:
    """White-space separated class tokens; empty if there is no class."""
    return F.filter(
        F.split(F.coalesce(F.try_element_at(attrs, F.lit("class")), F.lit("")), r"[ \t\r\n\f\x0b]+"),
        lambda c: c != "",
    )


def code_lang(classes: Column) -> Column:
    """H7: first ``language-X``, else the last well-known name, else empty."""
    return F.coalesce(
        F.get(
            F.transform(
                F.filter(classes, lambda c: c.startswith(LANG_PREFIX)),
                lambda c: F.substring(c, len(LANG_PREFIX) + 1, 2**31 - 1),
            ),
            F.lit(0),
        ),
        F.try_element_at(F.filter(classes, lambda c: c.isin(*KNOWN_LANGS)), F.lit(-1)),
        F.lit(""),
    )


def code_lines(text: Column) -> Column:
    """H8 and H9 in one pass: a line of one to three digits goes, a line of tree
    drawing only takes in the next line, whatever that is.

    Matches do not overlap and run from left to right, so a line that was taken
    in is not looked at itself, as the rule wants.
    """
    blank = f"[{SPACES}&&[^\n]]*+"
    number = rf"{_LINE}{blank}\p{{Nd}}{{1,3}}(?:\n|\z)"
    tree = rf"{_LINE}{blank}([{SPACES}{_TREE}&&[^\n]]++)\n({_LINE}){blank}([^\n]*+)"
    lines = F.transform(
        F.split(F.regexp_replace(text, rf"(?:{_LINE_END})\z", ""), _LINE_END),
        lambda line: F.concat(F.lit(_LINE), rstrip_ws(line)),
    )
    cleaned = F.regexp_replace(F.array_join(lines, "\n"), f"{number}|{tree}", "$1$2$3")
    for pattern, replacement in (
        (rf"(^|\n){_LINE}", "$1"),
        (rf"{_LINE}(?=\n|\z)", ""),
        (_LINE, " "),
    ):
        cleaned = F.regexp_replace(cleaned, pattern, replacement)
    return F.trim(cleaned, F.lit("\n"))


def fence(lang: Column, code: Column) -> Column:
    """H10."""
    return F.concat(
        F.lit(f"\n\n{FENCE}"), lang, F.lit("\n"), code, F.lit(f"\n{FENCE}\n\n")
    )


def _texts(events: Column, start: Column, end: Column) -> Column:
    inside = F.slice(events, start + 2, end - start - 1)
    return F.transform(F.filter(inside, lambda e: e.kind == "t"), lambda e: e.text)


def code_blocks(events: Column, body: Column) -> Column:
    """H6: ``array<struct<pre_no,pre_depth,lang,code>>`` of the pre elements in
    ``body``, which is a run of ``events``."""

    def block(pre: Column) -> Column:
        inner_code = F.get(
            F.filter(
                F.slice(events, pre.i + 2, pre.j - pre.i - 1),
                lambda e: (e.kind == "o") & (e.tag == "code"),
            ),
            F.lit(0),
        )

        def described(code: Column) -> Column:
            has_code = code.isNotNull()
            has_class = has_code & F.map_contains_key(code.attrs, "class")
            attrs = F.when(has_class, code.attrs).otherwise(pre.attrs)
            words = F.when(has_code, _texts(events, code.i, code.j)).otherwise(
                _texts(events, pre.i, pre.j)
            )
            return F.struct(
                pre.pre_no.alias("pre_no"),
                pre.pre_depth.alias("pre_depth"),
                let(class_list(attrs), code_lang).alias("lang"),
                code_lines(F.array_join(words, " ")).alias("code"),
            )

        return let(inner_code, described)

    return F.transform(
        F.filter(body, lambda e: (e.kind == "o") & (e.tag == "pre")), block
    )
