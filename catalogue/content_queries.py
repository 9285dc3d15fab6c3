"""Extraction, Markdown and text rules, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.inputs import PARTS, html_pages, origin_of, pages, table
from catalogue.registry import query
from pageloom.functions import render as R
from pageloom.functions import text as X
from pageloom.functions.events import parse_events
from pageloom.operators import aggregates as A
from pageloom.operators.content import extract_content, link_targets

# The article of a test page and, in SQL, what the rules make of it. In these
# pages only <p> and <b> stay open, and only there.
DECODE = "replace(regexp_replace({}, '&amp;?', '&', 'g'), '&quot;', '\"')"
ARTICLE = r"""a AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS art,
    (length(html) - length(replace(html, '<b>', ''))) // 3 AS open_b FROM pages)"""
_P, _B = "chr(1)", "chr(2)"
MARKED = f"""m AS (SELECT page_id, url, regexp_replace(
    replace(regexp_replace(regexp_replace(replace(art, '<h1>', '# '), '</h1>|</?p>', {_P}, 'g'),
      '<b>', '**', 'g'), '<br>', {_B}) 
      || CASE WHEN open_b > 0 THEN '**' || repeat({_P} || '**', open_b - 1) ELSE '' END,
    '\\s+', ' ', 'g') AS t FROM a)"""
SETTLED = f"""s AS (SELECT page_id, url, {DECODE.format(f'''regexp_replace(regexp_replace(t,
    ' *' || {_P} || '[ ' || {_P} || ']*', E'\\n\\n', 'g'), ' *' || {_B} || ' *', E'  \\n', 'g')''')}
    AS t FROM m)"""
MARKDOWN = f"""{ARTICLE}, {MARKED}, {SETTLED}, md AS (SELECT page_id, url, regexp_replace(
    regexp_replace(rtrim(t, E' \\n') || E'\\n', '\\*\\*(.*?)\\*\\*', '## \\1', 'g'),
    '\\n{{3,}}', E'\\n\\n', 'g') AS markdown FROM s)"""
TITLE = DECODE.format("trim(regexp_extract(html, '<title>(.*?)</title>', 1))")


def _content(spark, sf_dir, *fields):
    rows = html_pages(spark, sf_dir).select("page_id", "html")
    return extract_content(rows, fields).drop("error")


_TAGS = ("article", "a", "b", "br", "h1", "li", "meta", "p", "title")


@query(
    "parse_events",
    "WITH t AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in _TAGS) + """]) AS tag)
    SELECT page_id, tag, len(regexp_extract_all(html, '<' || tag || '[ >]')) AS opened,
      len(regexp_extract_all(html, '<' || tag || '[ >]')) AS closed
    FROM pages, t WHERE opened > 0""",
)
def parse_events_query(spark, sf_dir):
    parsed = html_pages(spark, sf_dir).select(
        "page_id", F.explode(parse_events(F.col("html"), ()).events).alias("e")
    )
    return (
        parsed.filter(F.col("e.tag").isin(*_TAGS))
        .groupBy("page_id", F.col("e.tag").alias("tag"))
        .agg(
            F.count_if(F.col("e.kind") == "o").alias("opened"),
            F.count_if(F.col("e.kind") == "c").alias("closed"),
        )
    )


@query("title", f"SELECT page_id, {TITLE} AS title FROM pages")
def title(spark, sf_dir):
    return _content(spark, sf_dir, "title")


@query(
    "links",
    rf"""WITH {PARTS}, h AS (
      SELECT page_id, origin, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM p),
    f AS (SELECT *, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos FROM h)
    SELECT page_id, pos::BIGINT AS pos, href, origin || href AS target FROM f""",
)
def links(spark, sf_dir):
    found = link_targets(html_pages(spark, sf_dir))
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "target")


@query(
    "distinct_urls",
    rf"""WITH {PARTS} SELECT DISTINCT origin,
      origin || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM p""",
)
def distinct_urls(spark, sf_dir):
    found = link_targets(html_pages(spark, sf_dir), ("url",))
    return A.distinct_urls(found.select(origin_of().alias("origin"), "target"), ("origin", "target"))


@query(
    "meta_refresh",
    rf"""WITH {PARTS} SELECT page_id, '/en/' || page_id AS href,
      origin || '/en/' || page_id AS target FROM p WHERE page_id % 4 = 0""",
)
def meta_refresh(spark, sf_dir):
    tag = F.concat(
        F.lit('<head><meta http-equiv="Refresh" content="0; URL=/en/'),
        F.col("page_id"),
        F.lit(' ;x">'),
    )
    html = F.when(
        F.col("page_id") % 4 == 0, F.replace("html", F.lit("<head>"), tag)
    ).otherwise(F.col("html"))
    rows = html_pages(spark, sf_dir).select("page_id", "url", html.alias("html"))
    return link_targets(rows).filter("pos = 0").select("page_id", "href", "target")


@query(
    "select_main_text",
    f"""WITH {ARTICLE} SELECT page_id, trim({DECODE.format('''regexp_replace(regexp_replace(
      replace(regexp_replace(art, '\\s+', ' ', 'g'), '<b>', ''),
      '</?(h1|p|br)>', E'\\n', 'g'), ' *\\n[ \\n]*', E'\\n', 'g')''')}, E' \\n') AS plain_text
    FROM a""",
)
def select_main_text(spark, sf_dir):
    return _content(spark, sf_dir, "plain_text")


CLEANED = f"""{ARTICLE}, cleaned AS (SELECT page_id, '<article>'
      || replace({DECODE.format("replace(art, '<br>', '<br/>')")}, '&', '&amp;')
      || repeat('</b></p>', open_b) || '</article>' AS html_cleaned FROM a)"""


@query("cleaned_html", f"WITH {CLEANED} SELECT page_id, html_cleaned FROM cleaned")
def cleaned_html(spark, sf_dir):
    return _content(spark, sf_dir, "html_cleaned")


@query("markdown", f"WITH {MARKDOWN} SELECT page_id, markdown FROM md")
def markdown(spark, sf_dir):
    return _content(spark, sf_dir, "markdown")


_PRES = (
    '<pre><code class="language-sql hl">1\nSELECT ',
    '\n  2\n</code></pre><pre class="x bash">├──\nrun <i>',
    "</i>\n12</pre></article>",
)


def _with_code(spark, sf_dir):
    added = F.concat(
        F.lit(_PRES[0]), "page_id", F.lit(_PRES[1]), "page_id", F.lit(_PRES[2])
    )
    return html_pages(spark, sf_dir).select(
        "page_id", F.replace("html", F.lit("</article>"), added).alias("html")
    )


@query(
    "code_blocks",
    """SELECT page_id, 0::BIGINT AS block_no, 'sql' AS lang, 'SELECT ' || page_id AS code FROM pages
    UNION ALL SELECT page_id, 1::BIGINT, 'bash', '├── run  ' || page_id FROM pages""",
)
def code_blocks(spark, sf_dir):
    found = extract_content(_with_code(spark, sf_dir), ("code_blocks",))
    return found.select("page_id", F.explode("code_blocks").alias("b")).select(
        "page_id", F.col("b.block_no").cast("bigint").alias("block_no"), "b.lang", "b.code"
    )


@query(
    "markdown_fences",
    """SELECT page_id, E'\\n\\n```sql\\nSELECT ' || page_id || E'\\n```\\n\\n```bash\\n├── run  '
      || page_id || E'\\n```\\n\\n' AS fences FROM pages""",
)
def markdown_fences(spark, sf_dir):
    found = extract_content(_with_code(spark, sf_dir), ("markdown",))
    # the fences follow the article's text, before its open elements close
    return found.select(
        "page_id", F.regexp_extract("markdown", r"(?s)(\n\n```.*```\n\n)", 1).alias("fences")
    )


# H12-H18 over whole documents, with patterns added that the texts lack.
_ADDED = "&#xf1;**b** y **c**\nnote(x)\nbash\n\n```\n1\n 2 \n\n3\nz\n\n\n\nend"
_TEXT = "text || E'" + _ADDED.replace("\n", "\\n") + "'"


def _documents(spark, sf_dir, rule):
    text = F.concat("text", F.lit(_ADDED))
    return table(spark, sf_dir, "documents").select("doc_id", rule(text).alias("text"))


# The patterns of the text rules, in the queries below.
def _rule_sql(pattern: str, replacement: str) -> str:
    return (
        f"SELECT doc_id, regexp_replace({_TEXT}, '{pattern}', {replacement}, 'g') AS text "
        "FROM documents"
    )


@query("strip_icon_entities", _rule_sql("&#x[0-9a-fA-F]+;", "''"))
def strip_icon_entities(spark, sf_dir):
    return _documents(spark, sf_dir, X.strip_icon_entities)


@query("bold_to_header", _rule_sql(r"\*\*(.*?)\*\*", r"'## \1'"))
def bold_to_header(spark, sf_dir):
    return _documents(spark, sf_dir, X.bold_to_header)


@query("note_break", _rule_sql(r"(^|\n)(note\(|s\()", r"E'\\1\n\n\\2'"))
def note_break(spark, sf_dir):
    return _documents(spark, sf_dir, X.note_break)


@query("merge_lang_label", _rule_sql(r"\n([a-zA-Z0-9_+-]{2,})\n\n```", r"E'\n```\\1\n'"))
def merge_lang_label(spark, sf_dir):
    return _documents(spark, sf_dir, X.merge_lang_label)


@query("drop_number_runs", _rule_sql(r"(?m)(?:^|\n)(?:\s*\d+\s*\n){3,}", r"E'\n'"))
def drop_number_runs(spark, sf_dir):
    return _documents(spark, sf_dir, X.drop_number_runs)


@query("collapse_blank_lines", _rule_sql(r"\n{3,}", r"E'\n\n'"))
def collapse_blank_lines(spark, sf_dir):
    return _documents(spark, sf_dir, X.collapse_blank_lines)


# R1-R5 over whole documents.
DOCS = """d AS (SELECT doc_id, source || ': ' || lang AS title,
  'https://docs.example/' || doc_id AS url, text, 1700000000 + doc_id AS date FROM documents)"""
MD_SQL = """E'---\\ntitle: ' || replace(title, ':', '-') || E'\\nurl: ' || url
  || E'\\ndate_scraped: ' || date || E'\\n---\\n' || text"""
JSON_SQL = """E'{\\n  "title": ' || to_json(title) || E',\\n  "url": ' || to_json(url)
  || E',\\n  "date_scraped": ' || date || E',\\n  "content": ' || to_json(text) || E'\\n}'"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws(": ", "source", "lang").alias("title"),
        F.concat(F.lit("https://docs.example/"), "doc_id").alias("url"),
        "text",
        (F.col("doc_id") + 1700000000).alias("date"),
    )


def _rendered(spark, sf_dir, rule):
    columns = [F.col(c) for c in ("title", "url", "text", "date")]
    return _docs(spark, sf_dir).select("doc_id", rule(*columns).alias("content"))


@query("render_md", f"WITH {DOCS} SELECT doc_id, {MD_SQL} AS content FROM d")
def render_md(spark, sf_dir):
    return _rendered(spark, sf_dir, R.render_md)


@query("render_json", f"WITH {DOCS} SELECT doc_id, {JSON_SQL} AS content FROM d")
def render_json(spark, sf_dir):
    return _rendered(spark, sf_dir, R.render_json)


@query(
    "render_json_record",
    f"""WITH {DOCS} SELECT doc_id, json_object('title', title, 'url', url,
      'date_scraped', date, 'content', text)::VARCHAR AS content FROM d""",
)
def render_json_record(spark, sf_dir):
    return _rendered(spark, sf_dir, R.json_record)


PLAIN = f"""{ARTICLE}, plain AS (SELECT page_id, trim({DECODE.format('''regexp_replace(regexp_replace(
      replace(regexp_replace(art, '\\s+', ' ', 'g'), '<b>', ''),
      '</?(h1|p|br)>', E'\\n', 'g'), ' *\\n[ \\n]*', E'\\n', 'g')''')}, E' \\n') AS content
    FROM a)"""


@query("render_txt", f"WITH {PLAIN} SELECT page_id, content FROM plain")
def render_txt(spark, sf_dir):
    return _content(spark, sf_dir, *R.body_fields("txt")).select(
        "page_id", R.render("txt").alias("content")
    )


@query(
    "render_dispatch",
    f"""WITH {DOCS} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {MD_SQL} WHEN 1 THEN {JSON_SQL}
      WHEN 2 THEN text ELSE '<p>' || text || '</p>' END AS content FROM d""",
)
def render_dispatch(spark, sf_dir):
    formats = F.array(*[F.lit(f) for f in ("md", "json", "txt", "html")])
    text = F.col("text")
    bodies = {
        "md": text,
        "json": text,
        "txt": text,
        "html": F.concat(F.lit("<p>"), text, F.lit("</p>")),
    }
    fmt = F.get(formats, (F.col("doc_id") % 4).cast("int"))
    return _docs(spark, sf_dir).select(
        "doc_id",
        R.render_dispatch(fmt, F.col("title"), F.col("url"), bodies, F.col("date")).alias(
            "content"
        ),
    )
