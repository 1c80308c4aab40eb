"""Breadth-first crawl of a page table, many sessions at once.

A queue visits pages level by level, and inside a level in the order their links were
queued. So a level is one table operation for all sessions together, and the loop on
the driver runs once per level and only counts rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, unnest
from ..functions.urls import host, link_score, url_key
from ..session import materialize

DEFAULT_MAX_PAGES = 50


def page_nodes(pages: DataFrame) -> DataFrame:
    """Slim page table for crawling: one row per URL key, with ``blank`` pages marked.

    When several URLs share a key the smallest one with text stands for them.
    """
    return (
        pages.select(url_key(F.col("url")).alias("key"), is_blank(F.col("text")).alias("blank"), "url", "title")
        .filter(F.col("key").isNotNull())
        .groupBy("key").agg(F.min(F.struct("blank", "url", "title")).alias("_p"))
        .select("key", F.col("_p.url").alias("url"), F.col("_p.title").alias("title"), F.col("_p.blank").alias("blank"))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """Links of the pages in :func:`page_nodes`: ``url, pos, link, link_key, link_host``."""
    return unnest(pages, ["url"], "links", "pos", "link").select(
        "url", "pos", "link", url_key(F.col("link")).alias("link_key"), host(F.col("link")).alias("link_host")
    ).filter(F.col("link_key").isNotNull())


def site_seeds(order: DataFrame, starts: DataFrame, *, max_pages: int = DEFAULT_MAX_PAGES, existing: DataFrame | None = None) -> DataFrame:
    """Seeds of sessions that share a site: ``session, url, position``.

    ``order`` has ``start, url, position`` and ``starts`` ``session, start``. Stored pages are never followed, and a session
    takes no more than ``max_pages`` others, one of which may be its own start; so a site is cut to that many before its
    sessions meet it.
    """
    named = order.withColumn("key", url_key(F.col("url"))).filter(F.col("key").isNotNull())
    if existing is not None:
        named = named.join(existing.select(F.col("url_key").alias("key")).distinct(), "key", "left_anti")
    first = named.groupBy("start", "key").agg(F.min(F.struct("position", "url")).alias("_m")).select("start", "_m.url", "_m.position")
    cut = first.withColumn("_nth", F.row_number().over(Window.partitionBy("start").orderBy("position"))).filter(F.col("_nth") <= max_pages)
    return starts.select("session", "start").join(cut.drop("_nth"), "start").select("session", "url", "position")


def crawl_bfs(pages: DataFrame, starts: DataFrame, *, max_pages: int = DEFAULT_MAX_PAGES,
              same_host: bool = True, existing: DataFrame | None = None,
              discovered: DataFrame | None = None, override: bool = False) -> DataFrame:
    """Visited pages: ``session, url, title, level, visit, ingested``.

    ``starts`` has ``session, start`` and may have ``question``; ``existing`` lists stored
    ``url_key`` values, never followed; ``discovered`` (``session, url, position``) is
    queued before the links of the start page. A start page is visited even if it is
    blank; other blank or missing pages are passed over. ``max_pages`` below 1 counts as 1.
    """
    max_pages = max(1, max_pages)
    if "question" not in starts.columns:
        starts = starts.withColumn("question", F.lit(None).cast("string"))
    nodes = materialize(page_nodes(pages), "nodes")
    edges = materialize(page_edges(pages), "edges")
    stored = None if existing is None else existing.select(F.col("url_key").alias("key")).distinct()
    sessions = starts.select("session", "question", host(F.col("start")).alias("_host"))

    def visit(frontier: DataFrame, level: int, done: DataFrame) -> DataFrame:
        """Accepted pages of a level, numbered on from the session's earlier ones."""
        order = Window.partitionBy("session").orderBy("at")
        found = frontier.join(nodes if not level else nodes.filter(~F.col("blank")), "key")
        # No session can take more than max_pages of a level, so Spark limits each before the shuffle.
        first = found.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= max_pages)
        return (
            first.join(done, "session", "left").withColumn("visit", F.col("_nth") + F.coalesce("_done", F.lit(0)))
            .filter(F.col("visit") <= max_pages)
            .select("session", "key", "url", "title", F.lit(level).alias("level"), "visit")
        )

    def seeded() -> DataFrame:
        """Discovered URLs as queue entries, up to the one that fills a session.

        Only seeds that are queued use up room: repeated, foreign and stored ones do not.
        """
        ok = host(F.col("url")) == F.col("_host") if same_host else F.lit(True)
        seeds = discovered.join(sessions, "session").select(
            "session", url_key(F.col("url")).alias("key"), F.col("position").cast("int").alias("position"), ok.alias("_ok"),
        ).filter(F.col("key").isNotNull())
        first = seeds.groupBy("session", "key").agg(F.min(F.struct("position", "_ok")).alias("_m")).select(
            "session", "key", "_m.position", "_m._ok").join(current.select("session", "key"), ["session", "key"], "left_anti")
        if stored is None:
            takes = F.col("_ok")
        else:
            first = first.join(stored.withColumn("_stored", F.lit(True)), "key", "left")
            takes = F.col("_ok") & F.col("_stored").isNull()
        before = Window.partitionBy("session").orderBy("position", "key").rowsBetween(Window.unboundedPreceding, -1)
        taken = F.coalesce(F.sum(takes.cast("int")).over(before), F.lit(0))
        return first.withColumn("_taken", taken).filter(F.col("_taken") < max_pages - 1).select(
            "session", "key", F.array(F.lit(0), F.col("position")).alias("at"), "_ok")

    def enqueue(queue: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """New links: the first mention of a key counts, even when it is then turned down."""
        fresh = queue.groupBy("session", "key").agg(F.min(F.struct("at", "_ok")).alias("_m")).join(
            known, ["session", "key"], "left_anti")
        fresh = materialize(fresh.select("session", "key", F.col("_m.at").alias("at"), F.col("_m._ok").alias("_ok")),
                            "fresh")
        takes = fresh.filter("_ok")
        if stored is not None:
            takes = takes.join(stored, "key", "left_anti")
        return takes.drop("_ok"), known.unionByName(fresh.select("session", "key"))

    none_done = starts.select("session", F.lit(0).alias("_done"))
    root = starts.select("session", url_key(F.col("start")).alias("key"), F.array(F.lit(0), F.lit(0)).alias("at"))
    current = materialize(visit(root, 0, none_done), "level")
    visited, known = current, current.select("session", "key")
    level = 0
    while level + 1 < max_pages and not current.isEmpty():
        links = current.join(edges, "url").join(sessions, "session")
        ranked = Window.partitionBy("session", "visit").orderBy(
            link_score(F.col("link"), F.col("question")).desc(), "pos")
        allowed = F.col("link_host") == F.col("_host") if same_host else F.lit(True)
        queue = links.select(
            "session", F.col("link_key").alias("key"),
            F.array(F.col("visit"), F.row_number().over(ranked)).alias("at"), allowed.alias("_ok"))
        if level == 0 and discovered is not None:
            queue = queue.unionByName(seeded())
        frontier, known = enqueue(queue, known)
        done = visited.groupBy("session").agg(F.max("visit").alias("_done"))
        level += 1
        current = materialize(visit(frontier, level, done), "level")
        visited = visited.unionByName(current)
    ingested = F.lit(True)
    if stored is not None and not override:
        marked = visited.join(stored.withColumn("_stored", F.lit(True)), "key", "left")
        ingested, visited = F.col("_stored").isNull(), marked
    return visited.select("session", "url", "title", "level", "visit", ingested.alias("ingested"))
