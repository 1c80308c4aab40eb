"""URL identities and scope tests as Column expressions.

Two identities exist and differ on purpose: :func:`url_key` recognises a stored
source (host and path), :func:`canonical_url` names a page during discovery (keeps the
meaningful part of the query).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scope and version rules.
HTML_EXTENSIONS = ("html", "htm", "xhtml")
BLOCKED_PARTS = ("/search", "/login", "/signin", "/logout", "/cart", "/feed", "/print/", "/cdn-cgi/")
BLOCKED_PARAMS = ("print", "download", "raw")
TRACKING_PARAMS = ("ref", "source", "fbclid")
TRACKING_PREFIX = "utm_"
CHANNEL_SEGMENT = (
    r"(?i)^(?:rc\d*|alpha|beta|snapshot|nightly|dev|next|latest|stable|current|main|master)$"
)
VERSION_SEGMENT = r"(?i)^v?\d[\w.-]*$"


def _part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(_part(url, "PROTOCOL")).isin("http", "https"), F.lit(False))


def host(url: Column) -> Column:
    """Lower-case host; empty when there is none or the URL is not http(s)."""
    return F.when(is_http(url), F.coalesce(F.lower(_part(url, "HOST")), F.lit(""))).otherwise(F.lit(""))


def decoded_path(url: Column) -> Column:
    """Path with percent escapes resolved; ``/`` when empty."""
    raw = F.coalesce(_part(url, "PATH"), F.lit(""))
    escaped = raw.contains("%")
    text = F.when(
        escaped, F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    ).otherwise(raw)
    return F.when(text == "", F.lit("/")).otherwise(text)


def url_path(url: Column) -> Column:
    """Path without its trailing slash."""
    return F.regexp_replace(decoded_path(url), r"(?<=.)/$", "")


def url_key(url: Column) -> Column:
    """``host/path`` of an http(s) URL, null for anything else."""
    return F.when(is_http(url), F.concat(host(url), url_path(url)))


def origin(url: Column) -> Column:
    return F.concat(F.lower(_part(url, "PROTOCOL")), F.lit("://"), F.lower(_part(url, "AUTHORITY")))


def is_web_page(url: Column) -> Column:
    return is_http(url) & _part(url, "HOST").isNotNull()


def base_dir(path: Column) -> Column:
    """Directory of a start path: a last segment with a dot is a file."""
    last = F.substring_index(path, "/", -1)
    return (
        F.when(last.contains("."), F.regexp_replace(path, r"[^/]*$", ""))
        .when(path.endswith("/"), path)
        .otherwise(F.concat(path, F.lit("/")))
    )


def _param_name(pair: Column) -> Column:
    return F.lower(F.substring_index(pair, "=", 1))


def _params(url: Column) -> Column:
    """Query pairs; trailing empty ones do not count."""
    query = F.regexp_replace(F.coalesce(_part(url, "QUERY"), F.lit("")), "&+$", "")
    return F.split(query, "&")


def in_scope(url: Column, start: Column) -> Column:
    """Whether ``url`` is a content page below the directory of ``start``.

    The path is compared in lower case with a directory that keeps its case, so a start
    directory with capitals accepts nothing.
    """
    path = F.lower(decoded_path(url))
    last = F.substring_index(path, "/", -1)
    asset = last.contains(".") & ~F.substring_index(last, ".", -1).isin(*HTML_EXTENSIONS)
    blocked = F.lit(False)
    for part in BLOCKED_PARTS:
        blocked = blocked | path.contains(part)
    param = F.exists(_params(url), lambda p: _param_name(p).isin(*BLOCKED_PARAMS))
    ok = (
        is_web_page(url) & (origin(url) == origin(start))
        & path.startswith(base_dir(decoded_path(start))) & ~asset & ~blocked & ~param
    )
    return F.coalesce(ok, F.lit(False))


def canonical_url(url: Column, start: Column) -> Column:
    """Origin of the start URL, tidied path, and the query sorted without tracking."""
    slim = F.regexp_replace(decoded_path(url), "/{2,}", "/")
    slim = F.regexp_replace(slim, "(?<=.)/$", "")
    slim = F.regexp_replace(slim, r"/index\.html$", "/")
    kept = F.array_sort(F.filter(_params(url), lambda p: ~(
        _param_name(p).startswith(TRACKING_PREFIX) | _param_name(p).isin(*TRACKING_PARAMS))))
    blank = F.trim(F.coalesce(_part(url, "QUERY"), F.lit(""))) == ""
    suffix = F.when(blank | (F.size(kept) == 0), F.lit("")).otherwise(
        F.concat(F.lit("?"), F.array_join(kept, "&")))
    return F.when(is_web_page(url), F.concat(origin(start), slim, suffix))


def family_key(url: Column) -> Column:
    """Authority and path without segments that name a release."""
    parts = F.filter(
        F.split(F.coalesce(decoded_path(url), F.lit("")), "/"),
        lambda s: (s != "") & ~s.rlike(CHANNEL_SEGMENT) & ~F.lower(s).rlike(VERSION_SEGMENT),
    )
    return F.concat(F.coalesce(_part(url, "AUTHORITY"), F.lit("null")), F.lit("/"), F.array_join(parts, "/"))


def directory(url: Column) -> Column:
    """Path up to and including the last slash."""
    path = _part(url, "PATH")
    return F.coalesce(F.regexp_replace(path, "[^/]*$", ""), F.lit(""))


def link_score(link: Column, question: Column) -> Column:
    """1 for a relative link, plus 2 for each longer question word found in it."""
    low = F.lower(link)
    words = F.split(F.lower(F.coalesce(question, F.lit(""))), r"\s+")
    hits = F.size(F.filter(words, lambda w: (F.length(w) > 3) & low.contains(w)))
    return F.when(low.startswith("http"), 0).otherwise(1) + 2 * hits
