"""The text of an exported document.

The date is an argument, never the clock, so a retried task writes the same
text. Without a date its line is left out; that form is what gets hashed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.config import FORMATS


def render_md(title: Column, url: Column, content: Column, date: Column | None = None) -> Column:
    """Front matter, then the body."""
    lines = [
        F.lit("---"),
        F.concat(F.lit("title: "), F.replace(title, F.lit(":"), F.lit("-"))),
        F.concat(F.lit("url: "), url),
    ]
    if date is not None:
        lines.append(F.concat(F.lit("date_scraped: "), date.cast("string")))
    return F.concat(F.concat_ws("\n", *lines, F.lit("---")), F.lit("\n"), content)


def json_string(text: Column) -> Column:
    """A JSON string literal with non-ASCII text kept."""
    literal = F.to_json(F.array(text))
    return F.substring(literal, F.lit(2), F.length(literal) - 2)


def render_json(title: Column, url: Column, content: Column, date: Column | None = None) -> Column:
    """R2: object with two-space indent."""
    members = [
        F.concat(F.lit('  "title": '), json_string(title)),
        F.concat(F.lit('  "url": '), json_string(url)),
    ]
    if date is not None:
        members.append(F.concat(F.lit('  "date_scraped": '), date.cast("string")))
    members.append(F.concat(F.lit('  "content": '), json_string(content)))
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *members), F.lit("\n}"))


def json_record(title: Column, url: Column, content: Column, date: Column) -> Column:
    """R2 on one line, for line-delimited sinks."""
    return F.to_json(
        F.struct(
            title.alias("title"),
            url.alias("url"),
            date.alias("date_scraped"),
            content.alias("content"),
        )
    )


def body_fields(fmt: str) -> tuple[str, ...]:
    """Content fields a format needs, so that nothing else is computed."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    return {
        "md": ("title", "markdown"),
        "json": ("title", "markdown"),
        "txt": ("title", "plain_text"),
        "html": ("title", "html_cleaned"),
    }[fmt]


def render(fmt: str, date: Column | None = None) -> Column:
    """The document in ``fmt`` from columns named as content fields."""
    body = F.col(body_fields(fmt)[-1])
    if fmt == "md":
        return render_md(F.col("title"), F.col("url"), body, date)
    if fmt == "json":
        return render_json(F.col("title"), F.col("url"), body, date)
    return body


def render_dispatch(
    fmt: Column, title: Column, url: Column, bodies: dict[str, Column], date: Column
) -> Column:
    """R5 with the format in a column; ``bodies`` gives the body of each format."""
    return (
        F.when(fmt == "md", render_md(title, url, bodies["md"], date))
        .when(fmt == "json", render_json(title, url, bodies["json"], date))
        .when(fmt == "txt", bodies["txt"])
        .when(fmt == "html", bodies["html"])
        .otherwise(F.raise_error(F.concat(F.lit("unknown format "), fmt)))
    )
