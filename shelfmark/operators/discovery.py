"""Finding and ordering the pages of a site.

All operators work on many start URLs at once: ``start`` is a column, and every
ranking is kept apart by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unnest
from ..functions.urls import (base_dir, canonical_url, decoded_path, directory, family_key, host, in_scope,
                              link_score, origin, url_key, url_path)
from ..session import materialize
from ..sources.readers import read_sitemaps
from .numbering import numbered

# Usual limits of a site visit; every operator takes None for no limit.
MAX_URLS = 2000
MAX_SITEMAPS = 25
MAX_DEPTH = 2
DEFAULT_TOP_LINKS = 5


def select_family(urls: DataFrame) -> DataFrame:
    """One URL per group that differs only by release: ``start, url, pos``.

    The start URL itself wins, else the shortest path, then the smallest; an aggregate
    of small structs, combined before the shuffle.
    """
    if "pos" not in urls.columns:
        urls = urls.withColumn("pos", F.lit(0).cast("bigint"))
    is_start = canonical_url(F.col("url"), F.col("url")).eqNullSafe(canonical_url(F.col("start"), F.col("start")))
    path = decoded_path(F.col("url"))
    order = F.struct(
        F.when(is_start, 0).otherwise(1).alias("r"),
        F.when(is_start, 0).otherwise(F.length(path)).alias("n"),
        F.when(is_start, F.lit("")).otherwise(path).alias("p"),
        F.col("pos"), F.col("url"))
    return (
        urls.groupBy("start", family_key(F.col("url")).alias("family"))
        .agg(F.min(order).alias("_best"), F.min("pos").alias("pos"))
        .select("start", F.col("_best.url").alias("url"), "pos")
    )


def structural_order(urls: DataFrame, limit: int | None = MAX_URLS) -> DataFrame:
    """Directories visited in turn, shortest page first: ``start, url, position``.

    Only the first ``limit`` pages of a directory can make the cut, so each directory is limited before
    anything is ranked across directories. None keeps all, and numbers a site of any size by ranges.
    """
    placed = urls.select("start", "url").distinct().withColumn("_len", F.length("url")).withColumn("_dir", directory(F.col("url")))
    if limit is None:
        rounds = numbered(placed, ["start", "_dir"], ["_len", "url"], "_round")
        heads = rounds.filter("_round = 1").select("start", "_dir", F.struct("_len", "url").alias("_head"))
        return numbered(rounds.join(heads, ["start", "_dir"]).select("start", "url", "_round", "_head"), ["start"], ["_round", "_head"], "position").select(
            "start", "url", "position")
    in_dir = Window.partitionBy("start", "_dir").orderBy("_len", "url")
    rounds = placed.withColumn("_round", F.row_number().over(in_dir)).filter(F.col("_round") <= limit).withColumn(
        "_head", F.min(F.struct("_len", "url")).over(Window.partitionBy("start", "_dir")))
    order = Window.partitionBy("start").orderBy("_round", "_head")
    return (
        rounds.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
        .select("start", "url", "position")
    )


def robots_allows(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs that no disallow rule of their host is a prefix of.

    A path is looked up under its beginnings, of the lengths the host's rules have, so it makes a few equality
    probes however many rules there are. Each distinct path is probed once.
    """
    active = rules.filter((F.col("kind") == "disallow") & (F.col("value") != "")).select(
        F.col("host").alias("_host"), F.col("value").alias("_rule")).distinct()
    lengths = active.groupBy("_host").agg(F.collect_set(F.length("_rule")).alias("_lengths"))
    tested = urls.withColumn("_h", host(F.col("url"))).withColumn("_p", url_path(F.col("url")))
    paths = tested.select(F.col("_h").alias("_host"), F.col("_p").alias("_path")).distinct().join(lengths, "_host")
    probes = paths.select("_host", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_n")).select(
        "_host", "_path", F.substring("_path", F.lit(1), F.col("_n")).alias("_rule"))
    closed = probes.join(active, ["_host", "_rule"], "left_semi").select("_host", "_path").distinct()
    return tested.join(closed, (F.col("_h") == F.col("_host")) & (F.col("_p") == F.col("_path")), "left_anti").drop("_h", "_p")


def sitemap_candidates(starts: DataFrame, rules: DataFrame) -> DataFrame:
    """Sitemaps named by robots, then the usual places: ``start, loc, path``."""
    s = F.col("start")
    usual = F.array(
        F.concat(origin(s), base_dir(decoded_path(s)), F.lit("sitemap.xml")),
        F.concat(origin(s), base_dir(decoded_path(s)), F.lit("sitemap_index.xml")),
        F.concat(origin(s), F.lit("/sitemap.xml")), F.concat(origin(s), F.lit("/sitemap_index.xml")))
    named = (
        rules.filter("kind = 'sitemap'").select(F.col("host").alias("_h"), F.col("pos"), F.col("value").alias("loc"))
        .join(starts.select("start", host(s).alias("_h")).distinct(), "_h")
        .select("start", "loc", F.array(F.lit(0), F.col("pos")).alias("path"))
    )
    fixed = starts.select("start", F.posexplode(usual).alias("pos", "loc")).select(
        "start", "loc", F.array(F.lit(1), F.col("pos")).alias("path"))
    return named.unionByName(fixed)


def expand_sitemaps(starts: DataFrame, rules: DataFrame, bodies: DataFrame, *, max_urls: int | None = MAX_URLS,
                    max_sitemaps: int | None = MAX_SITEMAPS, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """Page URLs listed by the sitemaps of each start: ``start, url, pos``.

    Indexes are followed to ``max_depth``, level by level; a sitemap counts where it is first reached, so
    indexes that name each other end the walk. Positions are paths such as ``[root, entry, entry]``, whose
    order is the order of a depth-first walk, so each level is one join and the limits on sitemaps and URLs
    are applied at the end. With a limit on URLs, locations out of scope use it up too. None lifts a limit.
    """
    # Each level is used several times; written out, its bodies are parsed only once.
    entries = materialize(read_sitemaps(bodies).select(
        F.col("url").alias("_map"), "is_index", "pos", F.col("loc").alias("child")), "entries")
    level = sitemap_candidates(starts, rules).withColumn("root", F.col("path"))
    seen, found, depth = None, None, 0
    while True:
        new = level if seen is None else level.join(seen.select("start", "loc").distinct(), ["start", "loc"], "left_anti")
        level = materialize(new, "sitemaps") if max_depth is None else level
        if max_depth is None and level.isEmpty():
            break
        seen = level if seen is None else seen.unionByName(level)
        listed = level.join(entries, F.col("loc") == F.col("_map")).select(
            "start", "root", F.col("loc").alias("parent"), "is_index",
            F.concat("path", F.array("pos")).alias("at"), F.col("path").alias("parent_path"),
            "child")
        listed = materialize(listed, "listed")
        pages = listed.filter(~F.col("is_index"))
        found = pages if found is None else found.unionByName(pages)
        level = listed.filter("is_index").select(
            "start", F.col("child").alias("loc"), F.col("at").alias("path"), "root")
        depth += 1
        if max_depth is not None and depth > max_depth:
            break
    # A sitemap counts where it is first reached; later mentions of it list nothing.
    first = seen.groupBy("start", "loc").agg(F.min(F.struct("path", "root")).alias("_f")).select(
        "start", "loc", F.col("_f.path").alias("path"), F.col("_f.root").alias("root"))
    valid = found.join(
        first.select("start", F.col("loc").alias("parent"), F.col("path").alias("parent_path")),
        ["start", "parent", "parent_path"], "left_semi")
    if max_sitemaps is not None:
        # A candidate is only tried while fewer sitemaps were read before it.
        before = Window.partitionBy("start").orderBy("path", "loc")
        roots = first.withColumn("_nth", F.row_number().over(before)).filter(
            F.col("_nth") <= max_sitemaps).select("start", "root").distinct()
        valid = valid.join(roots, ["start", "root"], "left_semi")
    distinct = valid.groupBy("start", F.col("child").alias("url")).agg(F.min("at").alias("at"))
    if max_urls is None:
        kept = numbered(distinct, ["start"], ["at", "url"], "pos")
    else:
        order = Window.partitionBy("start").orderBy("at", "url")
        kept = distinct.withColumn("pos", F.row_number().over(order).cast("bigint")).filter(F.col("pos") <= max_urls)
    return _tidy(robots_allows(kept.filter(in_scope(F.col("url"), F.col("start"))), rules))


def _tidy(urls: DataFrame) -> DataFrame:
    """Canonical, distinct, one per family; position is where each first appeared."""
    named = urls.select("start", canonical_url(F.col("url"), F.col("start")).alias("url"), "pos").filter(
        F.col("url").isNotNull())
    return select_family(named.groupBy("start", "url").agg(F.min("pos").alias("pos")))


def discover(pages: DataFrame, starts: DataFrame, limit: int | None = MAX_URLS, *,
             sitemap_urls: DataFrame | None = None) -> DataFrame:
    """URLs to visit from each start, in structural order: ``start, url, position``.

    ``pages`` has ``url, links, nav_links``. Navigation links of the start page (all its
    links when it has none) come first, then ``sitemap_urls`` if given.
    """
    start_pages = pages.withColumn("_key", url_key(F.col("url"))).join(
        starts.select("start", url_key(F.col("start")).alias("_key")).distinct(), "_key")
    links = F.when(F.size("nav_links") > 0, F.col("nav_links")).otherwise(F.col("links"))
    found = unnest(start_pages, ["start"], links, "pos", "url").select(
        "start", "url", F.col("pos").cast("bigint").alias("pos"))
    if sitemap_urls is not None:
        found = found.unionByName(sitemap_urls.select(
            "start", "url", (F.col("pos") + F.lit(1 << 40)).alias("pos")))
    scoped = found.filter(in_scope(F.col("url"), F.col("start")))
    named = (
        scoped.select("start", canonical_url(F.col("url"), F.col("start")).alias("url"), "pos")
        .filter(F.col("url").isNotNull() & (F.col("url") != canonical_url(F.col("start"), F.col("start"))))
        .groupBy("start", "url").agg(F.min("pos").alias("pos"))
    )
    return structural_order(select_family(named), limit)


def rank_links(links: DataFrame, by: list[str], question: str = "question") -> DataFrame:
    """Links of each ``by`` group with ``score`` and ``rank``; ties keep their position."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "pos")
    return links.withColumn("score", link_score(F.col("link"), F.col(question))).withColumn(
        "rank", F.row_number().over(order))


def top_links(pages: DataFrame, question: str | None, k: int = DEFAULT_TOP_LINKS) -> DataFrame:
    """The ``k`` most relevant links of every page and the page each leads to, if known."""
    links = unnest(pages, ["page_id"], "links", "pos", "link").withColumn(
        "question", F.lit(question))
    best = rank_links(links, ["page_id"]).filter(F.col("rank") <= k).withColumn("_key", url_key(F.col("link")))
    targets = (
        pages.withColumn("_key", url_key(F.col("url"))).groupBy("_key")
        .agg(F.min(F.struct("url", "page_id")).alias("_t"))
        .select("_key", F.col("_t.page_id").alias("target_id"))
    )
    return best.join(targets, "_key", "left").select("page_id", "rank", "link", "score", "target_id")
