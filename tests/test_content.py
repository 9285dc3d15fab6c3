"""Extraction and Markdown against hand-made values."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pageloom.functions.events import parse_events
from pageloom.operators.code import code_lines
from pageloom.operators.content import extract_content, link_targets


@pytest.fixture(scope="module")
def content(spark):
    def run(htmls, *fields):
        rows = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")
        found = extract_content(rows, fields).collect()
        return sorted(found, key=lambda r: r.page_id)

    return run


MAIN = [
    ('<div class="x content">A</div><article>B<nav>C</nav></article>', "B"),
    ('<div class="x content">A</div><article>B</article><main>D</main>', "D"),
    ('<div id="MainCol">E</div>', "E"),
    ('<body><div>a</div>b</body>', "a\nb"),
    ('<div class="document">d</div><div class="content">c</div>', "c"),
    ('<div class="contents">x</div><div class="theme-default-content">t</div>', "t"),
    ("<p>no <i>container</i></p>", "no container"),
    ("<form><main>gone</main></form><body>kept</body>", "kept"),
    ("<main></main><article>not this</article>", ""),
    ("<head><title>T</title></head><p>text</p>", "text"),
]


def test_main_content(content):
    got = [r.plain_text for r in content([h for h, _ in MAIN], "plain_text")]
    assert got == [t for _, t in MAIN]


TITLES = [
    ("<title> A &amp; B </title>", "A & B"),
    ("<header><title>in header</title></header><title>T</title>", "T"),
    ("<title><b>one</b></title>", "one"),
    ("<title>a<b>two</b></title>", ""),
    ("<title></title>", ""),
    ("<p>none</p>", ""),
    ("<title>first</title><title>second</title>", "first"),
]


def test_titles(content):
    assert [r.title for r in content([h for h, _ in TITLES], "title")] == [t for _, t in TITLES]


CODE = [
    ('<pre><code class="language-python">1\ndef f():\n  2\n    return 1\n</code></pre>',
     "python", "def f():\n    return 1"),
    ('<pre class="bash"><span>ls</span><span>-l</span></pre>', "bash", "ls -l"),
    ('<pre><code class="bash language-ts js">x</code></pre>', "ts", "x"),
    ('<pre><code class="js bash">x</code></pre>', "bash", "x"),
    ('<pre class="sh"><code class="">x</code></pre>', "", "x"),
    ('<pre class="sh"><code>x</code></pre>', "sh", "x"),
    ("<pre>├──\na\n12\nb</pre>", "", "├── a\nb"),
    ("<pre>---\nkey: v</pre>", "", "--- key: v"),
    ("<pre>a\n---</pre>", "", "a\n---"),
    ("<pre>|\n  7\n\n1234\n 99 </pre>", "", "| 7\n\n1234"),
]


def test_code_blocks(content):
    rows = content([f"<main>{h}</main>" for h, _, _ in CODE], "code_blocks", "markdown")
    assert [(r.code_blocks[0].lang, r.code_blocks[0].code) for r in rows] == [c[1:] for c in CODE]
    for row, (_, lang, code) in zip(rows, CODE):
        assert row.markdown == f"\n\n```{lang}\n{code}\n```\n\n"


def test_many_blocks_keep_their_own_text(content):
    html = "<main>" + "".join(f"<p>t{i}</p><pre>c{i}</pre>" for i in range(12)) + "</main>"
    markdown = content([html], "markdown")[0].markdown
    want = "\n\n".join(f"t{i}\n\n```\nc{i}\n```" for i in range(12))
    assert markdown.strip("\n") == want


def test_blocks_outside_main_do_not_shift_numbers(content):
    html = "<pre>out</pre><main><p>x</p><pre>in</pre></main><pre>after</pre>"
    row = content([html], "markdown", "code_blocks")[0]
    assert row.markdown.strip() == "x\n\n```\nin\n```"
    assert [b.code for b in row.code_blocks] == ["in"]


MARKDOWN = [
    ("<h1>A</h1><h3> B </h3><p>c</p>", "# A\n\n### B\n\nc\n"),
    ("<p>one</p><p>two<p>three", "one\n\ntwo\n\nthree\n"),
    ("x <i>it</i> <s>no</s> <code>f(x)</code>", "x _it_ ~~no~~ `f(x)`\n"),
    ("x <b>bold </b>y", "x ## bold y\n"),
    ("<b>a</b>. b", "## a. b\n"),
    ('<a href="/x(1)">t</a> <a href="#f">f</a> <a>g</a>', "[t](/x\\(1\\)) f g\n"),
    ('<a href="u" title="T">t</a>', '[t](u "T")\n'),
    ('<a href="http://e.com/">http://e.com/</a>', "<http://e.com/>\n"),
    ('<p>p</p><a href="u"><h2>T</h2><p>x</p></a>', "p\n\n## [Tx](u)\n"),
    ('<h2><a href="u">T</a></h2>x', "## [T](u)\n\nx\n"),
    ("a<br>b", "a  \nb\n"),
    ("a<hr>b", "a\n\n* * *\n\nb\n"),
    ("<ul><li>a</li><li><p>b</p><ol><li>c<li>d</ol></ul>e", "  * a\n  * b\n\n    1. c\n    2. d\n\ne\n"),
    ('<ol start="3"><li>a</li><li>b</li></ol>', "  3. a\n  4. b\n"),
    ("<table><tr><th>H</th> <th>I</th></tr><tr><td>1</td><td>2</td></tr></table>",
     "H | I  \n---|---  \n1| 2\n"),
    ("p<blockquote><p>q</p><p>r</p></blockquote>s", "p\n\n> q\n> \n> r\n\ns\n"),
    ("<p>1. x</p><p>- y</p><p>+ z</p><p>a \\* b</p>", "1\\. x\n\n\\- y\n\n\\+ z\n\na \\\\* b\n"),
    ("a &amp;#xf0; b &lt;i&gt;", "a  b <i>\n"),
    ("<!-- c -->a  \n b", "a b\n"),
    ("<p>x</p>\nnote(y)", "x\n\nnote(y)\n"),
    ("<dl><dt>t</dt><dd>d</dd></dl>", "t\n    d\n"),
    ("<div>bash<pre>ls</pre></div>", "bash\n\n```\nls\n```\n\n"),
]


def test_markdown(content):
    rows = content([f"<main>{h}</main>" for h, _ in MARKDOWN], "markdown")
    wrong = [(h, r.markdown, w) for r, (h, w) in zip(rows, MARKDOWN) if r.markdown != w]
    assert not wrong, wrong


HTML = [
    ('<main><p class="a  b">x<br>y &lt; &copy;</main>', '<main><p class="a b">x<br/>y &lt; ©</p></main>'),
    ("<main><input disabled><!-- c --><pre>\n a</pre></main>",
     '<main><input disabled=""/><!-- c --><pre>\n a</pre></main>'),
    ("""<main title='say "hi"'>x</main>""", """<main title='say "hi"'>x</main>"""),
    ("<main><nav>n</nav>a</b></main>", "<main>a</main>"),
    ("<p>no main</p>", ""),
]


def test_cleaned_html(content):
    rows = content([h for h, _ in HTML], "html_cleaned")
    assert [r.html_cleaned for r in rows] == [w for _, w in HTML]


def test_odd_pages(content):
    rows = content(["", None, "<![foo", "<" * 50, "</p></p>", "<b>" * 500 + "x"], "plain_text")
    assert [r.plain_text for r in rows[:2]] == ["", ""]
    assert rows[5].plain_text == "x"


def test_code_lines_against_a_loop(evaluate):
    rng = random.Random(4)
    pieces = ["1", "22 ", "1234", "|", " │ ", "--", "x y", "", "  z", "\t", "٣", "é-"]
    ends = ["\n", "\r\n", "\x0b", "\u2028", "\n"]
    texts = ["".join(rng.choice(pieces) + rng.choice(ends) for _ in range(rng.randint(0, 9)))
             + rng.choice(pieces) for _ in range(3000)]
    tree = re.compile("[\\s│└├┬─›>•·`~\\\\/|:_-]+")

    def loop(text):
        lines, out = text.splitlines(), []
        while lines:
            line = lines.pop(0).rstrip()
            if re.fullmatch(r"\s*\d{1,3}\s*", line):
                continue
            if tree.fullmatch(line) and lines:
                line = f"{line.strip()} {lines.pop(0).lstrip()}".rstrip()
            out.append(line)
        return "\n".join(out).strip("\n")

    got = evaluate(code_lines, [(t,) for t in texts], "t string")
    wrong = [(t, g, loop(t)) for t, g in zip(texts, got) if g != loop(t)]
    assert not wrong, wrong[:5]


def test_unclosed_markup_takes_no_long(content):
    started = time.time()
    n = 60_000
    pages = ["<!--" * n, "<a " * n, "</a " * n, "<?" * n, "<!x" * n, "<![CDATA[" * n, "<br>" * n + "</p>" * n]
    assert len(content(pages, "plain_text")) == len(pages)
    assert time.time() - started < 60


def test_events_nest(spark):
    page = "<p>a<p>b</i><br><script>if (a</b>) x</script><i>c"
    rows = spark.createDataFrame([(page,)], "html string")
    events = rows.select(parse_events(F.col("html"), ()).events.alias("e")).first().e
    assert [(e.kind, e.tag or e.text) for e in events] == [
        ("o", "p"), ("t", "a"), ("o", "p"), ("t", "b"), ("o", "br"), ("c", "br"),
        ("o", "script"), ("t", "if (a</b>) x"), ("c", "script"), ("o", "i"), ("t", "c"),
        ("c", "i"), ("c", "p"), ("c", "p")]
    for e in events:
        assert events[e.j].j == e.i


def test_links_and_refresh(spark):
    def refresh(value):
        return f'<meta http-equiv="Refresh" content="{value}"><nav><a href="b">x</a></nav><a>y</a>'

    pages = [(1, "https://h/d/", refresh("0;url=next.html")), (2, "https://h/d/", refresh("0; url=a;b")),
             (3, "https://h/d/", refresh("0; URL='n.html'"))]
    rows = link_targets(spark.createDataFrame(pages, "page_id int, url string, html string"))
    got = sorted((r.page_id, r.pos, r.href, r.target) for r in rows.collect())
    assert got == [
        (1, 0, "next.html", "https://h/d/next.html"), (1, 1, "b", "https://h/d/b"),
        (2, 0, "a", "https://h/d/a"), (2, 1, "b", "https://h/d/b"),
        (3, 1, "b", "https://h/d/b")]


def test_a_batch_is_sent_in_parts():
    """What a worker holds does not grow with the pages of a batch."""
    import pyarrow as pa

    from pageloom.functions import events

    pages = ["<p>a</p>" * 5_000, None, "<p>b</p>", "x"] * 8
    parts = iter(events._parse_batch(pa.array(pages), ()))
    sizes = [(len(part), len(part.field("events").flatten())) for part in parts]
    assert sum(n for n, _ in sizes) == len(pages) and sum(e for _, e in sizes) == 8 * (15_000 + 3 + 1)
    assert len(sizes) > 3 and max(e for _, e in sizes) <= events.CHUNK + 15_000
