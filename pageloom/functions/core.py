"""Small Column helpers shared by the rule modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space, spelled out since
# that is cheaper than a Unicode-aware ``\\s``. Goes inside a character class.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{SPACES}]"
_OTHER_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable.

    A Column referenced several times is copied into the plan several times,
    and a Column referenced inside a lambda is evaluated once per element. A
    one-element ``transform`` binds the value, so nested rules stay linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(maxsize=512)
def over(rule: Callable[..., Column], *names: str, **options) -> Column:
    """``rule`` over columns given by name, built once per process.

    A rule with nested lambdas takes thousands of calls into the JVM to build,
    which is seconds of driver time; the same Column serves every plan.
    """
    return rule(*[F.col(name) for name in names], **options)


def where_has(text: Column, needles: tuple[str, ...], rule: Callable[[Column], Column]) -> Column:
    """Apply ``rule`` only to texts that hold one of ``needles``: a substring
    search costs far less than a regex pass that finds nothing."""

    def guarded(t: Column) -> Column:
        found = t.contains(needles[0])
        for needle in needles[1:]:
            found = found | t.contains(needle)
        return F.when(found, rule(t)).otherwise(t)

    return let(text, guarded)


def one_blank(text: Column) -> Column:
    """Every run of white space as one blank. A translation and a substring
    search are several times cheaper than a regex over all characters."""
    blanks = F.translate(text, _OTHER_SPACES, " " * len(_OTHER_SPACES))
    return where_has(blanks, ("  ",), lambda t: F.regexp_replace(t, " {2,}", " "))


def strip_ws(value: Column) -> Column:
    """Trim all Unicode white space, where SQL ``trim`` only takes blanks."""
    return F.regexp_replace(value, rf"^{WS}++|(?<!{WS}){WS}++\z", "")


def rstrip_ws(value: Column) -> Column:
    return F.regexp_replace(value, rf"(?<!{WS}){WS}++\z", "")
