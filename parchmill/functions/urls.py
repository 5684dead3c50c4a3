"""URL expressions: validation, normal form, key, host, resolving, file names.

All of them are Column -> Column and stay inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmill.functions.binding import let

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/]*)"
_PATH = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/]*)?(.*)$"

# Characters a URL path, or a host, may carry unescaped.
_PATH_PLAIN = r"^(?:[A-Za-z0-9\-_.~!$&'()*+,;=:@/\[\]]|%[0-9A-Fa-f]{2})*$"
_PATH_KEPT = "$&+,/:;=@"
_HOST_KEPT = "!$&'()*+,;=:[]<>\""


def is_valid_url(url: Column) -> Column:
    """Case-sensitive test for an http or https URL."""
    return url.startswith("http://") | url.startswith("https://")


def url_host(url: Column) -> Column:
    """Host with port as written; empty when the URL has none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def _percent_encode(text: Column, kept: str) -> Column:
    """Percent-encode everything but unreserved characters and ``kept``."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return reduce(
        lambda acc, ch: F.replace(acc, F.lit(f"%{ord(ch):02X}"), F.lit(ch)),
        "~" + kept,
        out,
    )


def _query_encode(text: Column) -> Column:
    """Form encoding as used for query strings: space is ``+``, ``-_.~`` stay."""
    out = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def url_parse_problem(url: Column) -> Column:
    """Why a URL cannot be parsed at all, or NULL when it can."""
    no_fragment = F.substring_index(url, "#", 1)
    head = F.substring_index(no_fragment, "?", 1)
    authority = F.regexp_extract(head, _AUTHORITY, 1)
    host = F.regexp_extract(authority, r"([^@]*)$", 1)
    path = F.regexp_extract(head, _PATH, 1)
    bad_escape = F.regexp_extract(path, r"(%(?![0-9A-Fa-f]{2}).{0,2})", 1)
    bad_host_char = F.regexp_extract(host, r"([\x20\\^`{|}])", 1)
    bad_port = F.regexp_extract(host, r"^(?:\[[^\]]*\]|[^:\[]*)(:.*[^0-9].*)$", 1)
    quoted = F.concat(F.lit('parse "'), url, F.lit('": '))
    return (
        F.when(
            url.rlike(r"[\x00-\x1f\x7f]"),
            F.concat(quoted, F.lit("net/url: invalid control character in URL")),
        )
        .when(head.startswith(":"), F.concat(quoted, F.lit("missing protocol scheme")))
        .when(
            bad_host_char != "",
            F.concat(quoted, F.lit('invalid character "'), bad_host_char, F.lit('" in host name')),
        )
        .when(
            bad_port != "",
            F.concat(quoted, F.lit('invalid port "'), bad_port, F.lit('" after host')),
        )
        .when(
            bad_escape != "",
            F.concat(quoted, F.lit('invalid URL escape "'), bad_escape, F.lit('"')),
        )
    )


def normalize_url(url: Column) -> Column:
    """Normal form used for store keys; NULL when the URL cannot be parsed.

    Scheme and host are lower-cased, query pairs are sorted by key (a repeated
    key keeps its value order) and re-encoded, the fragment goes. Path case,
    trailing slash, user info and port stay.
    """

    def rebuild(no_fragment: Column) -> Column:
        head = F.substring_index(no_fragment, "?", 1)
        return F.concat(let(head, _normal_head), _normal_query(no_fragment))

    return F.when(url_parse_problem(url).isNull(), let(F.substring_index(url, "#", 1), rebuild))


def _normal_head(head: Column) -> Column:
    """Scheme, authority and path."""
    scheme = F.lower(F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1))
    slashes = F.regexp_extract(head, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(//)", 1)
    authority = F.regexp_extract(head, _AUTHORITY, 1)
    user_info = F.regexp_extract(authority, r"^(.*@)", 1)
    host = F.lower(F.regexp_extract(authority, r"([^@]*)$", 1))

    def plain_path(path: Column) -> Column:
        decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
        return F.when(path.rlike(_PATH_PLAIN), path).otherwise(_percent_encode(decoded, _PATH_KEPT))

    def plain_host(name: Column) -> Column:
        return F.when(name.rlike(r"[^\x00-\x7f]"), _percent_encode(name, _HOST_KEPT)).otherwise(name)

    path = F.regexp_extract(head, _PATH, 1)
    return F.concat(scheme, slashes, user_info, let(host, plain_host), let(path, plain_path))


def _normal_query(no_fragment: Column) -> Column:
    """Query with its question mark, pairs sorted by key and re-encoded."""

    def pair(item: Column, index: Column) -> Column:
        key = F.substring_index(item, "=", 1)
        value = F.regexp_extract(item, r"(?s)^[^=]*=(.*)$", 1)
        return F.struct(
            F.try_url_decode(key).alias("k"), index.alias("i"), F.try_url_decode(value).alias("v")
        )

    def encode(pairs: Column) -> Column:
        return F.array_join(
            F.transform(
                pairs, lambda p: F.concat(_query_encode(p["k"]), F.lit("="), _query_encode(p["v"]))
            ),
            "&",
        )

    query = F.regexp_extract(no_fragment, r"(?s)^[^?]*\?(.*)$", 1)
    usable = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    pairs = F.filter(F.transform(usable, pair), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    # A lone trailing question mark is kept, a query whose pairs all drop out is not.
    return (
        F.when(~F.contains(no_fragment, F.lit("?")), F.lit(""))
        .when(no_fragment.rlike(r"^[^?]*\?$"), F.lit("?"))
        .otherwise(
            let(
                encode(F.array_sort(pairs)),
                lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q)),
            )
        )
    )


def url_key(url: Column) -> Column:
    """SHA-256 hex of the normal form, 64 characters."""
    return F.sha2(normalize_url(url), 256)


def filename_slug(url: Column, title: Column) -> Column:
    """File name for one page: dashed host, slugged title, ``.md``."""
    host = F.replace(url_host(url), F.lit("."), F.lit("-"))
    words = F.when(F.coalesce(title, F.lit("")) == "", F.lit("article")).otherwise(title)
    slug = F.regexp_replace(F.lower(words), r"[^a-z0-9]+", "-")
    slug = F.substring(F.regexp_replace(slug, r"^-+|-+$", ""), 1, 100)
    named = F.when(host.isin("", "-"), F.concat(slug, F.lit(".md"))).otherwise(
        F.concat(host, F.lit("-"), slug, F.lit(".md"))
    )
    return F.when(url_parse_problem(url).isNotNull(), F.lit("article.md")).otherwise(named)


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` seen from page ``base``."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    no_fragment = F.substring_index(base, "#", 1)
    no_query = F.substring_index(no_fragment, "?", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*/)", 1)
    folder = F.coalesce(F.nullif(folder, F.lit("")), F.lit("/"))

    def against_base(ref: Column) -> Column:
        head = F.regexp_extract(ref, r"^([^?#]*)", 1)
        rest = F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
        joined = F.when(ref.startswith("/"), head).otherwise(F.concat(folder, head))
        return (
            F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
            .when(origin == "", ref)
            .when(ref == "", no_fragment)
            .when(ref.startswith("//"), F.concat(scheme, ref))
            .when(ref.startswith("#"), F.concat(no_fragment, ref))
            .when(ref.startswith("?"), F.concat(no_query, ref))
            .otherwise(F.concat(origin, let(joined, _without_dot_segments), rest))
        )

    return let(href, against_base)


def _without_dot_segments(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments of an absolute path."""
    folded = F.aggregate(
        F.split(path, "/", -1),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(seg))),
        lambda acc: F.array_join(acc, "/"),
    )
    trailing = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    out = F.regexp_replace(F.concat(folded, trailing), r"^/*", "/")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), out).otherwise(path)
