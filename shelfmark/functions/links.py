"""Links of raw HTML as Column expressions.

A page is read by regular expressions: comments, scripts and styles are cut out, then every ``href`` of an
``a`` tag is taken in order and resolved against the page's URL. Navigation is what lies in ``nav`` and ``aside``
elements, or in an element with ``role="navigation"`` or one of the usual class names, at any depth. Where it ends is
found by folding all tags in order: a container ends with its own closing tag, with that of an element around it, or
with the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HIDDEN = r"(?is)<!--.*?-->|<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>"
# Quoted values may hold angle brackets; the possessive loops neither backtrack nor recurse.
_QUOTED = r"""|"[^"]*+"|'[^']*+'"""
_TAG = rf"""</?[A-Za-z](?:[^>"']++{_QUOTED})*+>"""
_HREF = rf"""(?is)<a(?=\s)(?:[^>"'\s]++|\s(?!href\s*=){_QUOTED})*+\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_NAMES = "(?:toc|sidebar|sidebar-links)"
_MARK = (r"""(?:role\s*=\s*(?:navigation(?=[\s>])|"navigation"|'navigation')|"""
         rf"""class\s*=\s*(?:{_NAMES}(?=[\s>])|"(?:[^"]*\s)?{_NAMES}(?:\s[^"]*)?"|'(?:[^']*\s)?{_NAMES}(?:\s[^']*)?'))""")
_CONTAINER = rf"""(?is)^<(?:(?:nav|aside)(?![\w:-])|\w(?:[^>"'\s]++|\s(?!{_MARK}){_QUOTED})*+\s{_MARK})"""
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_IMPLIED = ("p", "li", "dt", "dd", "tr", "td", "th", "option")  # one ends where the next one of its name starts
# Character references that occur in links; the ampersand comes last.
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _unquoted(value: Column) -> Column:
    text = F.regexp_replace(value, r"""^["']|["']$""", "")
    for name, character in _REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return F.trim(text)


def hrefs(html: Column) -> Column:
    """The targets of all links in order, as they are written."""
    return F.transform(F.regexp_extract_all(html, F.lit(_HREF), F.lit(1)), _unquoted)


def navigation_tags(html: Column) -> Column:
    """The opening ``a`` tags inside navigation, in order.

    The fold keeps the names of the open elements and the place of the outermost container among them.
    """
    tags = F.transform(F.regexp_extract_all(html, F.lit(_TAG), F.lit(0)), lambda t: F.struct(
        t.alias("tag"), F.lower(F.regexp_extract(t, r"^</?([\w:-]+)", 1)).alias("name"), t.startswith("</").alias("closes"),
        t.rlike(_CONTAINER).alias("opens")))
    tags = F.filter(tags, lambda t: ~t["name"].isin(*_VOID))
    # Pages without navigation need no fold.
    tags = F.when(F.exists(tags, lambda t: t["opens"]), tags)
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("base"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        n = F.size(s["open"])
        back = F.array_position(F.reverse(s["open"]), t["name"]).cast("int")
        left = F.when(t["closes"] & (back > 0), n - back).when(
            ~t["closes"] & (back == 1) & t["name"].isin(*_IMPLIED), n - 1).otherwise(n)
        kept = F.slice(s["open"], F.lit(1), left)
        base = F.when(s["base"] > left, F.lit(0)).otherwise(s["base"])
        return F.struct(
            F.when(t["closes"], kept).otherwise(F.concat(kept, F.array(t["name"]))).alias("open"),
            F.when((base == 0) & t["opens"], left + 1).otherwise(base).alias("base"),
            F.when((base > 0) & (t["name"] == "a") & ~t["closes"], F.concat(s["found"], F.array(t["tag"]))).otherwise(s["found"]).alias("found"))

    return F.coalesce(F.aggregate(tags, start, step, lambda s: s["found"]), F.array().cast("array<string>"))


def _without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; nothing climbs above the root."""
    tail = F.regexp_extract(path, r"[?#].*$", 0)
    parts = F.split(F.regexp_extract(path, r"^[^?#]*", 0), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == ".", a).when(
        p == "..", F.slice(a, 1, F.greatest(F.lit(1), F.size(a) - 1))).otherwise(F.concat(a, F.array(p))))
    # A path that ends in a dot segment ends in a slash.
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")), tail)


def resolved(target: Column, url: Column) -> Column:
    """A link target as an absolute URL."""
    root = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    page = F.regexp_extract(url, r"^[^?#]*", 0)
    folder = F.when(page == root, F.lit("/")).otherwise(F.regexp_replace(F.substr(page, F.length(root) + 1), r"[^/]*$", ""))
    path = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    path = F.when(path.rlike(r"/\.{1,2}(?:[/?#]|$)"), _without_dots(path)).otherwise(path)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0), target))
        .when(target == "", F.regexp_extract(url, r"^[^#]*", 0))
        .when(target.startswith("#"), F.concat(F.regexp_extract(url, r"^[^#]*", 0), target))
        .when(target.startswith("?"), F.concat(page, target))
        .otherwise(F.concat(root, path))
    )


def link_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (``url, html``) with ``title``, ``text``, ``links`` and ``nav_links``; html is dropped.

    ``text`` is the page's characters outside tags, enough to tell a blank page.
    """
    read = pages.withColumn("_seen", F.regexp_replace(F.coalesce("html", F.lit("")), _HIDDEN, " "))
    areas = F.array_join(navigation_tags(F.col("_seen")), "\n")
    menu = F.array_distinct(F.filter(hrefs(areas), lambda h: (h != "") & ~h.startswith("#")))
    url = F.col("url")
    return read.select(
        *[F.col(c) for c in pages.columns if c != "html"],
        F.trim(F.regexp_extract("_seen", r"(?is)<title[^>]*>(.*?)</title", 1)).alias("title"),
        F.regexp_replace(F.regexp_replace("_seen", r"(?is)<title\b.*?</title\s*>", " "), r"<[^>]*>", " ").alias("text"),
        F.transform(hrefs(F.col("_seen")), lambda h: resolved(h, url)).alias("links"),
        F.array_distinct(F.transform(menu, lambda h: resolved(h, url))).alias("nav_links"))
