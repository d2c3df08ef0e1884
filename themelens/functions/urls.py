"""URL column expressions (H3, H4) with lenient, never-failing parsing.

Parsing follows the split a browser-agnostic URL library makes (scheme, network
location up to the first ``/?#``, path up to ``?#``) with regular expressions,
so malformed URLs never raise and the same patterns run in the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME_PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*):"
NETLOC_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
LEADING_DOTS_PATTERN = r"^(\.\.?/)+"


def url_scheme(c: Column) -> Column:
    return F.regexp_extract(c, SCHEME_PATTERN, 1)


def url_netloc(c: Column) -> Column:
    return F.regexp_extract(c, NETLOC_PATTERN, 1)


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, PATH_PATTERN, 1)


def site_base(url: Column) -> Column:
    """``scheme://netloc`` of a URL (the site root used as the join base)."""
    return F.concat(url_scheme(url), F.lit("://"), url_netloc(url))


def without_dots(path: Column) -> Column:
    """A reference's path below the root with ``.`` and ``..`` segments resolved.

    ``..`` cannot climb above the root; empty segments inside a relative path are dropped.
    """
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    inner = F.slice(parts, 1, F.size(parts) - 1)
    inner = F.when(path.startswith("/"), F.slice(inner, 2, F.size(parts))).otherwise(F.filter(inner, lambda s: s != ""))
    dots = last.isin(".", "..")
    kept = F.aggregate(
        F.concat(inner, F.array(last)), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, F.when(dots, F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>"))), "/"))


def resolve_url(href: Column, base: Column) -> Column:
    """H3: resolve ``href`` against a site root (a base without a path).

    Blanks and control characters before a reference, and tabs and line ends in it, are no part
    of it.  Absolute references stay as they are; ``//host`` takes the base scheme;
    ``?query``, ``#frag`` and ``''`` attach to the root; paths attach below the
    root with their dot segments resolved.
    """
    h = F.regexp_replace(F.translate(F.coalesce(href, F.lit("")), "\t\r\n", ""), r"\A[\x00-\x20]+", "")
    path = F.regexp_extract(h, r"^([^?#]*)", 1)
    return (F.when(h.rlike(SCHEME_PATTERN), h)
            .when(h.startswith("//"), F.concat(url_scheme(base), F.lit(":"), h))
            .when(path == "", F.concat(base, h))
            .otherwise(F.concat(base, without_dots(path), F.substring(h, F.length(path) + 1, F.length(h)))))


def is_item_url(url: Column, host_token: str, path_token: str) -> Column:
    """H4: non-empty network location containing ``host_token`` and a path containing
    ``path_token``; anything unparsable is simply False."""
    netloc, path = url_netloc(url), url_path(url)
    return F.coalesce((netloc != F.lit("")) & netloc.contains(host_token) & path.contains(path_token),
                      F.lit(False))


def resolve_sql(href: str, base: str) -> str:
    """The same resolution written for the SQL oracles."""
    return (f"CASE WHEN regexp_matches(coalesce({href}, ''), '{SCHEME_PATTERN}') THEN {href} "
            f"WHEN starts_with({href}, '//') THEN regexp_extract({base}, '{SCHEME_PATTERN}', 1) || ':' || {href} "
            f"WHEN coalesce({href}, '') = '' THEN {base} "
            f"WHEN starts_with({href}, '/') OR starts_with({href}, '?') OR starts_with({href}, '#') "
            f"THEN {base} || {href} "
            f"ELSE {base} || '/' || regexp_replace({href}, '{LEADING_DOTS_PATTERN}', '') END")


def base_sql(url: str) -> str:
    return (f"regexp_extract({url}, '{SCHEME_PATTERN}', 1) || '://' || "
            f"regexp_extract({url}, '{NETLOC_PATTERN}', 1)")
