"""Resolving relative links without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jobtide.functions.text import as_column, bound

# scheme, authority, path, query, fragment (RFC 3986, appendix B)
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_MARK = "\x01"


def _split(url: Column) -> Column:
    return F.split(F.regexp_replace(url, _PARTS, _MARK.join(f"${i}" for i in range(1, 6))), _MARK)


def _squeeze_path(path: Column, joined: Column) -> Column:
    """Resolve '.' and '..' of a rooted path; where it was joined to a base, empty segments inside go too."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    inner = F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0)))
    inner = F.when(joined, F.filter(inner, lambda s: s != "")).otherwise(inner)
    walked = F.aggregate(
        F.concat(F.array(F.lit("")), inner, F.array(last)),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    open_end = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(walked, open_end), "/")
    return F.when(text.startswith("/"), text).otherwise(F.concat(F.lit("/"), text))


def _join(raw: Column, link: Column, mine: Column, theirs: Column) -> Column:
    scheme, host, path, query, fragment = [mine[i] for i in range(5)]
    base_scheme, base_host, base_path, base_query = [theirs[i] for i in range(4)]
    bare = (path == "") & (host == "")
    joined = (
        F.when(host != "", path)
        .when(bare, base_path)
        .when(path.startswith("/"), path)
        .otherwise(F.concat(F.regexp_replace(base_path, "[^/]*$", ""), path))
    )

    def settle(p: Column) -> Column:
        rooted = F.when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
        # Only a path with a dot segment or an empty one needs the walk.
        odd = p.rlike(r"//|(^|/)\.{1,2}(/|$)")
        return F.when((host != "") | bare | ~odd, rooted).otherwise(_squeeze_path(rooted, ~path.startswith("/")))

    new_query = F.when(bare & (query == ""), base_query).otherwise(query)
    absolute = F.concat(
        F.lower(base_scheme),
        F.lit("://"),
        F.when(host != "", host).otherwise(base_host),
        bound(joined, settle),
        F.when(new_query != "", F.concat(F.lit("?"), new_query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    foreign = (scheme != "") & (F.lower(scheme) != F.lower(base_scheme))
    return F.when(foreign, link).otherwise(absolute)


def resolve_url(href, base) -> Column:
    """Absolute form of ``href`` seen from ``base``; http(s) links and foreign schemes are left alone."""
    raw, origin = as_column(href), as_column(base)
    link = F.regexp_replace(F.regexp_replace(raw, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    resolved = bound(link, lambda k: bound(_split(k), lambda mine: bound(_split(origin), lambda theirs: _join(raw, k, mine, theirs))))
    return F.when(raw.isNull() | (raw == "") | raw.rlike("^https?://"), raw).otherwise(resolved)
