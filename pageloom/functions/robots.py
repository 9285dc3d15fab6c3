"""Robots rules as Column expressions over one robots text.

All rules of an origin stay in one array next to the origin, so that a page is
tested without a row per page and rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.core import let, strip_ws
from pageloom.functions.urls import _opt, build_url, url_parts

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def unquote(text: Column) -> Column:
    """Percent-decode; broken escapes and plus signs stay as they are."""
    literal = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(F.replace(literal, F.lit("+"), F.lit("%2B")))
    return F.when(text.contains("%"), decoded).otherwise(text)


def _line(raw: Column) -> Column:
    """One line as a letter and its value: B blank, U agent, A allow, D deny,
    X another directive that still ends the list of agents; NULL otherwise."""
    body = strip_ws(F.substring_index(raw, "#", 1))

    def coded(line: Column) -> Column:
        key = F.lower(strip_ws(F.substring_index(line, ":", 1)))
        value = F.translate(
            unquote(strip_ws(F.substring(line, F.instr(line, ":") + 1, F.lit(2**31 - 1)))),
            "\r\n",
            "",
        )
        return F.when(
            line.contains(":"),
            F.when(key == "user-agent", F.concat(F.lit("U"), value))
            .when(key == "allow", F.concat(F.lit("A"), value))
            .when(
                key == "disallow",
                # nothing disallowed means everything allowed
                F.when(value == "", F.lit("A")).otherwise(F.concat(F.lit("D"), value)),
            )
            .when(key.isin("crawl-delay", "request-rate"), F.lit("X")),
        )

    return F.when(raw == "", F.lit("B")).otherwise(let(body, coded))


def _prefix(path: Column) -> Column:
    """A rule path without empty delimiters, as a URL is written."""
    return let(
        url_parts(path),
        lambda u: F.concat(
            build_url(u.scheme, u.authority, u.path, u.params, u.query),
            _opt("#", u.fragment),
        ),
    )


def robots_groups(body: Column) -> Column:
    """``array<struct<agents, rules array<struct<allow,prefix>>>>`` in file order.

    A group is a run of agent lines followed by a run of directives with no
    blank line in between; agents cut off by a blank line, and directives
    without agents, do not count.
    """
    coded = F.array_join(
        F.filter(F.transform(F.split(body, _LINE_END), _line), lambda c: c.isNotNull()), "\n"
    )
    groups = F.regexp_extract_all(
        F.concat(coded, F.lit("\n")),
        F.lit(r"(?dm)^((?:U[^\n]*+\n)++(?:[ADX][^\n]*+\n)++)"),
        F.lit(1),
    )

    def group(text: Column) -> Column:
        lines = F.split(text, "\n")
        return F.struct(
            F.transform(
                F.filter(lines, lambda s: s.startswith("U")),
                lambda s: F.substring(s, 2, 2**31 - 1),
            ).alias("agents"),
            F.transform(
                F.filter(lines, lambda s: s.rlike("^[AD]")),
                lambda s: F.struct(
                    s.startswith("A").alias("allow"),
                    _prefix(F.substring(s, 2, 2**31 - 1)).alias("prefix"),
                ),
            ).alias("rules"),
        )

    return F.transform(groups, group)


def rules_for_agent(groups: Column, agent: str) -> Column:
    """Rules of the first group naming ``agent``, else of the first ``*`` group."""
    token = agent.split("/")[0].lower()
    general = F.filter(groups, lambda g: F.array_contains(g.agents, "*"))
    named = F.filter(
        groups,
        lambda g: ~F.array_contains(g.agents, "*")
        & F.exists(g.agents, lambda a: F.lit(token).contains(F.lower(a))),
    )
    return F.coalesce(
        F.get(F.transform(named, lambda g: g.rules), F.lit(0)),
        F.get(F.transform(general, lambda g: g.rules), F.lit(0)),
    )


def robots_policy(status: Column, body: Column, agent: str) -> Column:
    """``struct<verdict boolean, rules>`` of an origin: a fixed verdict by
    status, or NULL and the rules that apply to ``agent``.

    401/403 deny, other 4xx allow, a failed read or anything else but success
    denies.
    """
    ok = status.between(200, 299)
    verdict = F.when(
        ~F.coalesce(ok, F.lit(False)),
        F.coalesce(status.between(400, 499) & ~status.isin(401, 403), F.lit(False)),
    )
    return F.struct(
        verdict.alias("verdict"),
        F.when(ok, rules_for_agent(robots_groups(body), agent)).alias("rules"),
    )


def robots_allowed(policy: Column, url: Column, missing: bool = True) -> Column:
    """First rule in file order whose prefix the decoded URL has decides."""

    def rest(u: Column) -> Column:
        text = F.concat(
            build_url(F.lit(""), F.lit(""), u.path, u.params, u.query), _opt("#", u.fragment)
        )
        return let(text, lambda t: F.when(t == "", F.lit("/")).otherwise(t))

    def first_match(path: Column) -> Column:
        return F.get(
            F.filter(policy.rules, lambda r: path.startswith(r.prefix)), F.lit(0)
        ).allow

    by_rule = let(let(url_parts(unquote(url)), rest), first_match)
    return (
        F.when(policy.isNull(), F.lit(missing))
        .when(policy.verdict.isNotNull(), policy.verdict)
        .when(F.coalesce(F.size(policy.rules), F.lit(0)) == 0, F.lit(True))
        .otherwise(F.coalesce(by_rule, F.lit(True)))
    )
