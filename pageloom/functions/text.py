"""Clean-up rules on Markdown text, each a linear regex.

Java differences that matter: spelled-out Unicode classes, ``(?d)`` so that
only ``\\n`` ends a line, possessive quantifiers so that long runs neither
backtrack nor recurse.
"""

# The patterns of this module are fixed values: the results of the text rules depend on
# them exactly.

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.core import SPACES, let, where_has

FENCE = "```"


def strip_icon_entities(text: Column) -> Column:
    """Drop hexadecimal character references that were left as text."""
    return where_has(text, ("&#x",), lambda t: F.regexp_replace(t, "&#x[0-9a-fA-F]+;", ""))


def bold_to_header(text: Column) -> Column:
    """``**x**`` within a line becomes ``## x``."""
    return where_has(
        text, ("**",), lambda t: F.regexp_replace(t, r"(?d)\*\*(.*?)\*\*", "## $1")
    )


def note_break(text: Column) -> Column:
    """Two newlines before a line that begins with ``note(`` or ``s(``."""
    return where_has(
        text,
        ("note(", "s("),
        lambda t: F.regexp_replace(t, r"(^|\n)(note\(|s\()", "$1\n\n$2"),
    )


def merge_lang_label(text: Column) -> Column:
    """A one-word line before a fence becomes the language of the fence."""
    return where_has(
        text,
        (f"\n\n{FENCE}",),
        lambda t: F.regexp_replace(
            t, rf"\n([a-zA-Z0-9_+-]{{2,}})\n\n{FENCE}", f"\n{FENCE}$1\n"
        ),
    )


def drop_number_runs(text: Column) -> Column:
    """Three or more lines holding only a number become one newline.

    The guard looks for a single number line, starting from a newline, which is
    quick to search for.
    """
    blank = f"[{SPACES}&&[^\\n]]*+"
    number_line = rf"[{SPACES}]*+\p{{Nd}}++{blank}\n"

    def guarded(t: Column) -> Column:
        dropped = F.regexp_replace(
            t, rf"(?:\A|\n)(?:{number_line}){{3,}}+(?:{blank}\n)*+", "\n"
        )
        return F.when(F.concat(F.lit("\n"), t).rlike(rf"\n{number_line}"), dropped).otherwise(t)

    return let(text, guarded)


def collapse_blank_lines(text: Column) -> Column:
    """At most one blank line in a row."""
    return where_has(text, ("\n\n\n",), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))


def before_fences(text: Column) -> Column:
    """H12-H14, which must not see code."""
    return note_break(bold_to_header(strip_icon_entities(text)))


def after_fences(text: Column) -> Column:
    """H16-H18, which run over the text with its code back in place."""
    return collapse_blank_lines(drop_number_runs(merge_lang_label(text)))
