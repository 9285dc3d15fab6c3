"""Quotes: parsing, links, threads."""

from conftest import SF
from oracle import compare, connect

from pageloom.llm.queries import ORACLES, QUERIES
from pageloom.llm.quotation import link_quotes, pieces, split_quotes


def test_levels():
    text = "top\n\nAnn wrote:\n> one\n> two\n>> deep\n > > also deep\n> back\nbottom"
    assert split_quotes(text) == (
        "top\n\nbottom",
        [(1, "one\ntwo"), (2, "deep\nalso deep"), (1, "back")],
    )
    assert split_quotes("") == ("", []) and split_quotes("a > b") == ("a > b", [])
    assert split_quotes("> only") == ("", [(1, "only")])


def test_pieces_ignore_wrapping_and_case():
    assert pieces("A  b\nc") == {"a b c", "a b", "c"} and pieces(" \n") == set()


SCHEMA = "conv_id long, turn long, role string, text string, thread string, own int"


def linked(spark, rows):
    table = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)
    names = ["conv_id", "turn", "text", "reply_to", "by_quote", "thread", "depth"]
    return sorted(map(tuple, link_quotes(table).select(names).collect()), key=repr)


def test_links(spark):
    rows = [
        (1, 0, "user", "First question\nsecond line"),
        (1, 1, "assistant", "An answer"),
        (1, 2, "user", "Why?\n\nBob wrote:\n> FIRST   question\n> second\n> line"),  # wrapped anew
        (1, 3, "user", "> An answer\n>> First question\nok"),
        (1, 4, "user", "> nobody said this\nhm"),
        (1, 6, "user", "gap, no quote"),
        (1, 7, "user", "> Quote of a later one\nx"),
        (1, 8, "user", "Quote of a later one"),
        (2, 0, "user", "First question"),
        (2, 5, "user", "> An answer"),  # said in another conversation only
    ]
    assert linked(spark, rows) == sorted(
        [
            (1, 0, "First question\nsecond line", None, False, 0, 0),
            (1, 1, "An answer", 0, False, 0, 1),
            (1, 2, "Why?", 0, True, 0, 1),
            (1, 3, "ok", 1, True, 0, 2),
            (1, 4, "hm", 3, False, 0, 3),
            (1, 6, "gap, no quote", None, False, 6, 0),
            (1, 7, "x", 6, False, 6, 1),
            (1, 8, "Quote of a later one", 7, False, 6, 2),
            (2, 0, "First question", None, False, 0, 0),
            (2, 5, "", None, False, 5, 0),
        ],
        key=repr,
    )


def test_defined_results(spark):
    rows = [
        (1, 0, "user", None),
        (1, 1, None, "again"),
        (1, 1, None, "again"),
        (1, 2, "user", "> again\nyes"),
        (None, 3, "user", "> again"),
        (1, None, "user", "lost"),
        (3, 0, "user", "same"),
        *[(3, i, "user", "same") for i in range(1, 40)],  # equal texts make no pairs
        (3, 40, "user", "> same\nend " + "x" * 300_000),
    ]
    got = linked(spark, rows)
    assert len(got) == len(rows)
    assert (1, 0, "", None, False, 0, 0) in got and got.count((1, 1, "again", 0, False, 0, 1)) == 2
    assert (1, 2, "yes", 1, True, 0, 2) in got
    assert (None, 3, "", None, False, 3, 0) in got and (1, None, "lost", None, False, None, 0) in got
    assert (3, 39, "same", 38, False, 0, 39) in got
    assert [r[3:] for r in got if r[:2] == (3, 40)] == [(0, True, 0, 1)]
    assert linked(spark, []) == []


def test_formatted(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi\n> x"), (1, 1, None, "yo")], "conv_id long, turn long, role string, text string")
    assert [r.formatted for r in link_quotes(table).orderBy("turn").collect()] == ["<|user|>\nhi", "<||>\nyo"]


def test_oracle(spark):
    name = "op8_quotation_linking"
    assert compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name]) is None
