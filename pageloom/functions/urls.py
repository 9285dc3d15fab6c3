"""URL algebra as Column expressions.

Splitting follows RFC 3986 leniently: a blank or a pipe in the path is kept,
``;params`` belong to the last path segment, and no port, escape or query
order is rewritten. Nothing here needs Python, so Catalyst can push the
predicates built from these functions towards the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.core import let

_MARK = "\ufdd0"  # a Unicode noncharacter, so no valid URL holds it
_SPLIT = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
    r"((?:[^?#]*/)?[^?#/;]*)(?:;([^?#]*))?(?:\?([^#]*))?(?:#(.*))?\z"
)
_FIELDS = ("scheme", "authority", "path", "params", "query", "fragment")


def url_parts(url: Column) -> Column:
    """``struct<scheme,authority,path,params,query,fragment>``.

    One regex pass marks the borders, one split cuts them. Missing parts are
    empty strings; a NULL url gives NULL fields.
    """
    cleaned = F.regexp_replace(
        F.regexp_replace(url, r"^[\x00-\x20]++", ""), rf"[\t\r\n{_MARK}]", ""
    )
    marked = F.regexp_replace(cleaned, _SPLIT, _MARK.join(f"${i}" for i in range(1, 7)))
    return let(
        F.split(marked, _MARK),
        lambda p: F.struct(
            F.lower(p[0]).alias("scheme"),
            *[p[i].alias(_FIELDS[i]) for i in range(1, 6)],
        ),
    )


def _opt(prefix: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(prefix), value)).otherwise("")


def build_url(scheme, authority, path, params, query) -> Column:
    """Put parts together again; empty parts lose their delimiter."""
    rooted = path.startswith("/")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), authority))
        .when((scheme != "") & (((path == "") & (params == "")) | rooted), F.lit("//"))
        .otherwise(""),
        F.when((authority != "") & (path != "") & ~rooted, F.lit("/")).otherwise(""),
        path,
        _opt(";", params),
        _opt("?", query),
    )


def _fold_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments; a trailing one leaves a slash."""

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(
                segment == "..",
                F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept),
            )
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    folded = let(
        F.split(path, "/"),
        lambda segments: F.aggregate(
            F.concat(
                segments,
                F.when(
                    F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))
                ).otherwise(F.array().cast("array<string>")),
            ),
            F.array().cast("array<string>"),
            step,
            lambda kept: F.array_join(kept, "/"),
        ),
    )
    return let(folded, lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def _merge_paths(base_path: Column, path: Column) -> Column:
    merged = F.when(path.startswith("/"), path).otherwise(
        F.regexp_replace(
            F.concat(F.regexp_replace(base_path, r"[^/]*+\z", ""), F.lit("/"), path),
            "/{2,}",
            "/",
        )
    )
    return let(
        merged, lambda p: F.when(p.rlike(r"(?:^|/)\.\.?(?:/|\z)"), _fold_dots(p)).otherwise(p)
    )


def _resolved(base: Column, href: Column) -> Column:
    """Parts of ``href`` seen from ``base``, both given as part structs."""

    def pick(scheme, authority, path, params, query):
        return F.struct(
            scheme.alias("scheme"),
            authority.alias("authority"),
            path.alias("path"),
            params.alias("params"),
            query.alias("query"),
        )

    h, b = href, base
    foreign = (h.scheme != "") & (h.scheme != b.scheme)
    own = pick(
        F.when(h.scheme == "", b.scheme).otherwise(h.scheme),
        h.authority,
        h.path,
        h.params,
        h.query,
    )
    same_document = pick(
        b.scheme,
        b.authority,
        b.path,
        b.params,
        F.when(h.query == "", b.query).otherwise(h.query),
    )
    relative = pick(b.scheme, b.authority, _merge_paths(b.path, h.path), h.params, h.query)
    return (
        F.when(foreign | (h.authority != ""), own)
        .when((h.path == "") & (h.params == ""), same_document)
        .otherwise(relative)
    )


def _usable(parts: Column) -> Column:
    """P7 and the malformed-authority test (unbalanced brackets)."""
    brackets = parts.authority.contains("[") == parts.authority.contains("]")
    return parts.scheme.isin("http", "https") & brackets


def normalize_url(base: Column, href: Column) -> Column:
    """Absolute http(s) URL without fragment, host in lower case, else NULL."""

    def finish(u: Column) -> Column:
        return F.when(
            _usable(u), build_url(u.scheme, F.lower(u.authority), u.path, u.params, u.query)
        )

    resolved = let(
        url_parts(base),
        lambda b: let(url_parts(href), lambda h: let(_resolved(b, h), finish)),
    )
    return F.when(href != "", resolved)


def url_resolve(base: Column, href: Column) -> Column:
    """Absolute URL of ``href``; the fragment of ``href`` is kept."""

    def finish(u: Column, h: Column) -> Column:
        return F.concat(
            build_url(u.scheme, u.authority, u.path, u.params, u.query),
            _opt("#", h.fragment),
        )

    resolved = let(
        url_parts(base),
        lambda b: let(url_parts(href), lambda h: let(_resolved(b, h), lambda u: finish(u, h))),
    )
    return F.when(href == "", base).otherwise(resolved)


def url_defrag(url: Column) -> Column:
    """Cut from the first ``#``."""
    return F.substring_index(url, "#", 1)


def url_host_lower(url: Column) -> Column:
    """U4: lower-case the authority; an empty query loses its ``?``."""
    return let(
        url_parts(url),
        lambda u: F.concat(
            build_url(u.scheme, F.lower(u.authority), u.path, u.params, u.query),
            _opt("#", u.fragment),
        ),
    )


def normalize_seed(seed: Column) -> Column:
    """A seed whose path does not end in a slash gets one at its very end."""
    return let(
        url_parts(seed),
        lambda u: F.when(
            (u.path != "") & ~u.path.endswith("/"), F.concat(seed, F.lit("/"))
        ).otherwise(seed),
    )


def crawl_base(seed: Column) -> Column:
    """Scheme, host and directory of a seed, without its query.

    The host is lower-cased as the candidates' hosts are, so that a seed in
    mixed case has a scope at all.
    """
    return let(
        url_parts(seed),
        lambda u: F.concat(
            u.scheme,
            F.lit("://"),
            F.lower(u.authority),
            u.path,
            F.when(u.path.endswith("/"), "").otherwise("/"),
        ),
    )


def domain_key(seed: Column) -> Column:
    """U8: output partition of a seed."""
    return F.coalesce(F.nullif(url_parts(seed).authority, F.lit("")), F.lit("unknown"))


def url_origin(url: Column) -> Column:
    """``scheme://host`` in lower case, the key of robots and sitemap lookups."""
    return let(
        url_parts(url), lambda u: F.concat(u.scheme, F.lit("://"), F.lower(u.authority))
    )


def slugify_path(root_url: Column, page_url: Column, fmt: Column | str = "md") -> Column:
    """Relative file path that mirrors the URL path of a page."""
    ext = F.lit(fmt) if isinstance(fmt, str) else fmt

    def named(path: Column) -> Column:
        return (
            F.when(path.endswith("/"), F.concat(path, F.lit("index")))
            .when(path == "", F.lit("index"))
            .otherwise(path)
        )

    def flattened(path: Column, root: Column) -> Column:
        folder = F.regexp_replace(path, r"/index\z", "")
        return F.when(
            path.endswith("/index") & (folder != root) & (folder != F.concat(root, F.lit("/"))),
            F.when(folder.isin("", "/"), F.lit("index")).otherwise(folder),
        ).otherwise(path)

    def sanitised(path: Column) -> Column:
        safe = F.regexp_replace(path, r"[^a-zA-Z0-9/_\-]", "-")
        safe = F.regexp_replace(F.regexp_replace(safe, "/{2,}", "/"), r"^/|/\z", "")
        return let(safe, lambda s: F.when(s == "", F.lit("index")).otherwise(s))

    return let(
        F.regexp_replace(url_parts(root_url).path, r"/++\z", ""),
        lambda root: let(
            F.regexp_replace(named(url_parts(page_url).path), r"\.html\z", ""),
            lambda path: F.concat(sanitised(flattened(path, root)), F.lit("."), ext),
        ),
    )


def content_sha1(text: Column) -> Column:
    """SHA-1 of the UTF-8 text."""
    return F.sha1(text)
