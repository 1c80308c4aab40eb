"""URL functions, discovery, crawling, duplicates and the chunk store."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import markup
from shelfmark.functions import urls as U
from shelfmark.functions.links import link_pages
from shelfmark.operators import crawl, discovery, duplicates, inspection
from shelfmark.session import fresh_dir
from shelfmark.sources import store as sinks


@pytest.mark.parametrize("url, want", [
    ("HTTPS://Example.COM/Guide/?q=1#intro", "example.com/Guide"), ("http://e.com", "e.com/"), ("http://e.com/", "e.com/"),
    ("http://e.com:8080/a/", "e.com/a"), ("ftp://e.com/a", None), ("not a url", None), (None, None), ("mailto:x@y.z", None),
    ("http://e.com/a%20b", "e.com/a b")])
def test_url_key(value, url, want):
    assert value([url], U.url_key(F.col("t")))[0] == want


START = "https://docs.e.com/guide/index.html"


@pytest.mark.parametrize("url, ok, canonical", [
    ("https://docs.e.com/guide/a?b=2&a=1&ref=x&utm_source=y", True, "https://docs.e.com/guide/a?a=1&b=2"),
    ("https://docs.e.com/guide//x/index.html", True, "https://docs.e.com/guide/x/"),
    ("https://docs.e.com/guide/x/", True, "https://docs.e.com/guide/x"),
    ("https://DOCS.e.com/guide/p.html#frag", True, "https://docs.e.com/guide/p.html"),
    ("https://docs.e.com/other", False, "https://docs.e.com/other"), ("http://docs.e.com/guide/a", False, "https://docs.e.com/guide/a"),
    ("https://docs.e.com/guide/pic.png", False, "https://docs.e.com/guide/pic.png"),
    ("https://docs.e.com/guide/search?q=1", False, "https://docs.e.com/guide/search?q=1"),
    ("https://docs.e.com/guide/a?print=1", False, "https://docs.e.com/guide/a?print=1"), ("javascript:void(0)", False, None)])
def test_scope_and_canonical(value, url, ok, canonical):
    assert value([url], U.in_scope(F.col("t"), F.lit(START)), U.canonical_url(F.col("t"), F.lit(START)))[0] == (ok, canonical)


def test_scope_with_capitals_accepts_nothing(value):
    start = F.lit("https://e.com/Guide/")
    assert value(["https://e.com/Guide/a"], U.in_scope(F.col("t"), start))[0] is False


def urls(spark, start, items):
    return spark.createDataFrame([(start, u, i) for i, u in enumerate(items)], "start string, url string, pos long")


def test_family(spark):
    start = "https://e.com/docs/3.0/intro"
    df = urls(spark, start, ["https://e.com/docs/3.1/intro", "https://e.com/docs/latest/intro", start,
                             "https://e.com/docs/v2/b", "https://e.com/docs/main/b", "https://e.com/c"])
    rows = discovery.select_family(df).orderBy("pos").collect()
    assert [r["url"] for r in rows] == [start, "https://e.com/docs/v2/b", "https://e.com/c"]


def test_structural_order(spark):
    s = "https://e.com/"
    df = urls(spark, s, [s + p for p in ("a/2", "a/1", "b/1", "b/22", "a/333", "top")])
    rows = discovery.structural_order(df).orderBy("position").collect()
    assert [r["url"][len(s):] for r in rows] == ["a/1", "b/1", "top", "a/2", "b/22", "a/333"]
    assert discovery.structural_order(df, 2).count() == 2


def test_robots(spark):
    pages = spark.createDataFrame([("http://h/a/b",), ("http://h/c",), ("http://o/a/b",)], "url string")
    rules = spark.createDataFrame([("h", "disallow", 0, "/a"), ("h", "disallow", 1, ""), ("h", "sitemap", 2, "/c")], "host string, kind string, pos int, value string")
    assert {r["url"] for r in discovery.robots_allows(pages, rules).collect()} == {"http://h/c", "http://o/a/b"}


def test_sitemaps(spark):
    e = "https://e.com"
    page = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"
    index = lambda *locs: page(*locs).replace("urlset", "sitemapindex")
    bodies = spark.createDataFrame([
        (e + "/s.xml", index(e + "/m1.xml", e + "/m2.xml", e + "/bad.xml")), (e + "/m1.xml", page(e + "/p1", e + "/x.png", e + "/private/1")),
        (e + "/m2.xml", index(e + "/m3.xml")), (e + "/m3.xml", page(e + "/p3?utm_a=1", "https://other.com/p")), (e + "/bad.xml", "<a"),
        (e + "/sitemap.xml", page(e + "/p1", e + "/p0"))], "url string, body string")
    rules = spark.createDataFrame([("e.com", "sitemap", 0, e + "/s.xml"), ("e.com", "disallow", 1, "/private")], "host string, kind string, pos int, value string")
    starts = spark.createDataFrame([(e + "/",)], "start string")
    rows = discovery.expand_sitemaps(starts, rules, bodies).orderBy("pos").collect()
    assert [r["url"] for r in rows] == [e + "/p1", e + "/p3", e + "/p0"]


def test_discover_and_links(spark):
    e = "https://e.com/g/"
    pages = spark.createDataFrame([(1, e + "start", [e + "z"], [e + "a?ref=1", e + "a", e + "start/", e + "start/b/1", e + "start/b/2", e + "start/c"])],
                                  "page_id int, url string, links array<string>, nav_links array<string>")
    starts = spark.createDataFrame([(e + "start",)], "start string")
    rows = discovery.discover(pages, starts).orderBy("position").collect()
    # Below the start's directory only; version-like last segments fall into one family.
    assert [r["url"] for r in rows] == [e + "start/c", e + "start/b/1"]
    links = spark.createDataFrame([(1, 0, "https://x.org/other"), (1, 1, "https://x.org/java-streams"), (1, 2, "rel/page")], "g int, pos int, link string")
    ranked = discovery.rank_links(links.withColumn("question", F.lit("Java streams")), ["g"]).orderBy("rank").collect()
    assert [(r["pos"], r["score"]) for r in ranked] == [(1, 4), (2, 1), (0, 0)]
    plain = discovery.rank_links(links.withColumn("question", F.lit(None).cast("string")), ["g"]).orderBy("rank").collect()
    assert [r["pos"] for r in plain] == [2, 0, 1]


PAGES = [
    '<div class="sidebar"><div><a href=1></a></div><a href=2></a></div><a href=3></a>',
    '<nav><nav><a href="/a">x</a></nav><a href="/b">y</a></nav><a href="/c">z</a>',
    '<ul role="navigation"><li><ul><li><a href="a">x</a></ul><li><a href="b">y</a></ul><a href="c">z</a>',
    '<aside><a href="a">x</a><p><a data-href="no" href="b">y</a>',
    '<NAV><div class="toc"><A HREF="a">x</A></div><a class="k" href=\'b\'>y</a></NAV><a href="c">z</a>',
    '<div class="my-toc toc2"><a href="a">x</a></div><div class="x toc"><a title="a>b" href="b">y</a></div>',
    '<div data-class="toc"><a href="a">x</a></div><img class="toc"><a href="b">x</a><nav></nav><a href="c">z</a>',
    '<a class="toc" href="self">x</a><a data-href="only">y</a><navy><a href="z">x</a></navy><a href="#t">q</a>', "plain", "",
    '<div><nav><a href="a">x</a></div><a href="b">y</a>', '<nav><p><a href="a">x</a><p></div><a href="b">y</a>',
    "<b " + "x='y' " * 5000 + "><nav><a " + "x='y' " * 5000 + 'href="a">x</a></nav>']


def test_links_and_navigation_equal_the_parser(spark):
    url = "https://e.com/g/start"
    pages = spark.createDataFrame([(i, url, h) for i, h in enumerate(PAGES)], "i int, url string, html string")
    for r in link_pages(pages).collect():
        want = markup.web_page(PAGES[r["i"]], url)
        assert (r["links"], r["nav_links"]) == (want["links"], want["nav_links"]), PAGES[r["i"]]


def crawl_model(graph, texts, start, max_pages, same_host, existing, seeds=()):
    """A queue, one page at a time."""
    key = lambda u: u.split("//")[1].rstrip("/")
    host = lambda u: u.split("//")[1].split("/")[0]
    known, queue, out, current = {key(start)}, [], [], start

    def offer(link):
        if key(link) in known:
            return
        known.add(key(link))
        if (not same_host or host(link) == host(start)) and key(link) not in existing:
            queue.append(link)

    for s in seeds:
        if len(queue) >= max_pages - 1:
            break
        offer(s)
    while current:
        out.append((current, key(current) not in existing))
        for link in graph.get(current, []):
            offer(link)
        current = None
        while queue and len(out) < max_pages and current is None:
            nxt = queue.pop(0)
            current = nxt if texts.get(nxt, "").strip() else None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_crawl_equals_queue(spark, seed):
    rnd = random.Random(seed)
    names = [f"https://{h}.com/p{i}" for h in ("a", "b") for i in range(14)]
    graph = {u: [rnd.choice(names) for _ in range(rnd.randint(0, 5))] for u in names}
    texts = {u: rnd.choice(["text", "text", "text", " "]) for u in names}
    texts[names[0]], texts[names[15]], texts[names[3]] = "text", "text", " "  # a blank start page is visited all the same
    existing = {names[5].split("//")[1], names[3].split("//")[1]}
    pages = spark.createDataFrame([(u, "t", texts[u], graph[u]) for u in names], "url string, title string, text string, links array<string>")
    starts = spark.createDataFrame([(u, u) for u in (names[0], names[3], names[15])], "session string, start string")
    old = spark.createDataFrame([(k,) for k in existing], "url_key string")
    # Stored, foreign and repeated seeds do not use up room.
    seeds = [names[5], names[7], names[20], names[7], names[1], names[9], names[2], names[11], names[12], names[8]]
    found = spark.createDataFrame([(names[0], u, i + 1) for i, u in enumerate(seeds)], "session string, url string, position int")
    for same, cap in ((True, 6), (False, 9), (True, 3)):
        rows = crawl.crawl_bfs(pages, starts, max_pages=cap, same_host=same, existing=old, discovered=found).orderBy("session", "visit").collect()
        for s in (names[0], names[3], names[15]):
            got = [(r["url"], r["ingested"]) for r in rows if r["session"] == s]
            assert got == crawl_model(graph, texts, s, cap, same, existing, seeds if s == names[0] else ())


def test_links_of_pages(spark):
    from shelfmark.functions.links import link_pages

    html = ("<title> Some &amp; title</title><!-- <a href='/no'>x</a> --><nav><a href='/m?a=1&amp;b=2'>m</a><a href=''>e</a><a href='#f'>f</a>"
            "<A class=x HREF=up/../side.html>s</A></nav><script>var a = '<a href=\"/js\">';</script>"
            "<a href=\"../top\">t</a><a name=n>n</a><a href='mailto:a@b.c'>w</a><a href='//cdn.org/x'>c</a><a href='?q=2'>q</a>"
            "<div class='left sidebar'><a href=\"/m?a=1&amp;b=2\">again</a><a href='HTTP://o.org'>o</a></div>")
    pages = spark.createDataFrame([(1, "https://E.com/d/e/f.html?x#y", html), (2, "http://h.org", "<p> </p>"), (3, "http://h.org/", None)],
                                  "id int, url string, html string")
    one, two, three = link_pages(pages).orderBy("id").collect()
    assert one["title"] == "Some &amp; title"
    assert one["links"] == ["https://E.com/m?a=1&b=2", "https://E.com/d/e/f.html?x", "https://E.com/d/e/f.html?x#f", "https://E.com/d/e/side.html",
                            "https://E.com/d/top", "mailto:a@b.c", "https://cdn.org/x", "https://E.com/d/e/f.html?q=2", "https://E.com/m?a=1&b=2", "HTTP://o.org"]
    assert one["nav_links"] == ["https://E.com/m?a=1&b=2", "https://E.com/d/e/side.html", "HTTP://o.org"]
    assert two["links"] == [] and two["text"].strip() == "" and three["links"] == [] and three["title"] == ""


def docs(spark, rows):
    return duplicates.with_content_hash(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_duplicates(spark):
    stored = duplicates.tag_stores({
        "basic": docs(spark, [(5, "x", "http://e.com/a"), (3, "x", "http://e.com/b/")]), "advanced": docs(spark, [(1, "x", "http://e.com/b"), (2, "y", "bad")])})
    incoming = docs(spark, [(10, "x", "http://e.com/b?q"), (11, "z", "http://e.com/n"), (12, None, "bad")])
    rows = {r["doc_id"]: (r["match_id"], r["match_module"]) for r in duplicates.find_by_content_hash(incoming.select("doc_id", "content_hash"), stored).collect()}
    assert rows == {10: (3, "basic"), 11: (None, None), 12: (None, None)}
    index = duplicates.source_index(stored)
    assert {r["url_key"]: r["match_id"] for r in index.collect()} == {"e.com/a": 5, "e.com/b": 3}
    keyed = incoming.withColumn("url_key", U.url_key(F.col("source")))
    assert {r["doc_id"] for r in duplicates.skip_known(keyed, index, "url_key").collect()} == {11, 12}
    kept, new = duplicates.override_known(keyed, index, stored, "url_key")
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 5} and new.count() == 3
    batch = docs(spark, [(1, "a", ""), (2, "a", ""), (3, None, ""), (4, None, ""), (5, "b", "")])
    assert {r["doc_id"] for r in duplicates.dedup_in_batch(batch).collect()} == {1, 3, 4, 5}


def chunk_rows(spark, rows):
    return spark.createDataFrame([(f"{v}-{d}-{i}", d, i, c, [1.0], v) for v, d, i, c in rows],
                                 "chunk_id string, doc_id string, chunk_index int, content string, embedding array<float>, variant string")


def test_store_roundtrip(spark):
    store = sinks.ChunkStore(spark, fresh_dir(spark, "t"), boot=("advanced", "v1"))
    store.delete(spark.createDataFrame([("x",)], "doc_id string"))
    store.upsert(chunk_rows(spark, [("v1", "d1", 0, "a"), ("v1", "d1", 1, "b"), ("v1", "d2", 0, "c"), ("v2", "d1", 0, "z")]))
    store.upsert(chunk_rows(spark, [("v1", "d1", 1, "B"), ("v1", "d3", 0, "n")]))
    store.upsert(chunk_rows(spark, [("v1", "d1", 0, "m")]), module="advanced")
    read = lambda: {(r["module"], r["chunk_id"]): r["content"] for r in store.read().collect()}
    assert read() == {("basic", "v1-d1-0"): "a", ("basic", "v1-d1-1"): "B", ("basic", "v1-d2-0"): "c", ("basic", "v1-d3-0"): "n",
                      ("basic", "v2-d1-0"): "z", ("advanced", "v1-d1-0"): "m"}
    assert store.read().filter("chunk_id = 'v1-d1-1'").first()["metadata"] == {"documentId": "d1", "chunkIndex": "1"}
    store.delete(spark.createDataFrame([("d1",), ("unknown",)], "doc_id string"))
    assert read() == {("basic", "v1-d2-0"): "c", ("basic", "v1-d3-0"): "n"}
    store.upsert(chunk_rows(spark, [("v1", "d1", 0, "back"), ("v1", "d1", 0, "again")]).coalesce(1))  # after its deletion, the last row counts
    assert read() == {("basic", "v1-d2-0"): "c", ("basic", "v1-d3-0"): "n", ("basic", "v1-d1-0"): "again"}
    before = read()
    store.compact("basic", "v1")
    assert read() == before and store._batches("rows/module=basic/variant=v1/batch=*") == [store._next() - 1]
    store.upsert(chunk_rows(spark, [("v1", "d8", 0, "e")]), batch=40)
    store.upsert(chunk_rows(spark, [("v1", "d8", 0, "f")]), batch=40)  # a replay replaces itself
    assert read() == before | {("basic", "v1-d8-0"): "f"}
    with pytest.raises(ValueError):
        store.drop_variant("advanced", "v1")
    store.drop_variant("basic", "v1")
    assert store.read().count() == 0
    plan = sinks.ChunkStore(spark, store.path)  # a missing embedding is refused
    with pytest.raises(Exception, match="has no embedding"):
        plan.upsert(chunk_rows(spark, [("v1", "d9", 0, "a")]).withColumn("embedding", F.lit(None).cast("array<float>")))


def test_store_reads_neither_sort_nor_compare_contents(spark):
    store = sinks.ChunkStore(spark, fresh_dir(spark, "t"))
    every = [("v1", f"d{i}", 0, f"first {i}") for i in range(50)]
    store.upsert(chunk_rows(spark, every))
    plan = lambda: store.read()._jdf.queryExecution().toString()
    assert "Join" not in plan() and "Window" not in plan() and "Sort" not in plan()
    store.upsert(chunk_rows(spark, [("v1", "new", 0, "n")]))
    assert "Join" not in plan()  # nothing was replaced
    store.upsert(chunk_rows(spark, [("v1", f"d{i}", 0, f"second {i}") for i in range(0, 50, 2)] * 2))
    assert "Window" not in plan() and "LeftAnti" in plan()
    read = lambda: {r["doc_id"]: r["content"] for r in store.read().collect()}
    want = {f"d{i}": f"{'first' if i % 2 else 'second'} {i}" for i in range(50)} | {"new": "n"}
    assert read() == want and store.read().count() == 51 and not {"pos", "seq", "batch"} & set(store.read().columns)
    # Batch 0 comes again with other rows: what later batches replaced stays replaced.
    store.upsert(chunk_rows(spark, [("v1", "d2", 0, "late"), ("v1", "d3", 0, "again"), ("v1", "only", 0, "o")]), batch=0)
    assert read() == {f"d{i}": f"second {i}" for i in range(0, 50, 2)} | {"new": "n", "d3": "again", "only": "o"}
    # Rows whose ids are not written yet are not read.
    store._append(sinks.with_store_metadata(chunk_rows(spark, [("v1", "half", 0, "x")])).withColumn("module", F.lit("basic")).withColumn(
        "seq", F.lit(0).cast("bigint")).withColumn("pos", F.lit(0).cast("bigint")), 77, "rows", "module", "variant")
    assert "half" not in read()
    before = read()
    store.compact("basic", "v1")
    assert read() == before and "Join" not in plan()


def test_store_takes_the_last_by_seq(spark):
    store = sinks.ChunkStore(spark, fresh_dir(spark, "t"))
    rows = chunk_rows(spark, [("v1", "d1", 0, c) for c in "abc"])
    store.upsert(rows.withColumn("seq", F.when(F.col("content") == "b", 9).otherwise(1)))
    assert [r["content"] for r in store.read().collect()] == ["b"]


def test_inspection(spark):
    c = spark.createDataFrame([("i1", "d1", 10, "late"), ("i2", "d1", 2, "early"), ("i3", None, 0, "o"), ("i4", "", 0, "e")],
                              "chunk_id string, doc_id string, chunk_index int, title string").withColumn("source", F.lit("s"))
    first = {r["doc_id"]: r for r in inspection.list_documents(c, ["title"]).collect()}
    assert first["d1"]["title"] == "early" and None not in first
    assert {(r["doc_id"], r["orphans"]) for r in inspection.orphan_chunks(c).collect()} == {(None, 1), ("", 1)}
    assert {r["doc_id"] for r in inspection.count_by_document_having(c, "d1").collect()} == {None, ""}
    assert sinks.delete_orphans(c).count() == 2
    jobs = spark.createDataFrame([("b", 1, "COMPLETED", 3, None), ("b", 2, "FAILED", None, "boom"), ("c", 3, "RUNNING", None, None)],
                                 "batch string, doc_id int, state string, chunk_count int, message string")
    assert [r["summary"] for r in inspection.batch_summary(jobs).collect()] == ["b: 1 page(s) complete, 1 failed, 3 chunk(s) total."]
    assert [r["failure"] for r in inspection.batch_failures(jobs).collect()] == [" - 2: boom"]


def test_numbering_across_ranges(spark):
    import random

    from shelfmark.operators.numbering import numbered

    rnd = random.Random(2)
    rows = [("hot", rnd.randrange(10**6), i) for i in range(8000)] + [(f"g{i % 40}", rnd.randrange(50), i) for i in range(700)] + [(None, 3, 1), (None, 1, 2)]
    df = spark.createDataFrame(rows, "g string, o int, id int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = numbered(df, ["g"], ["o", "id"], "n")
        per = {}
        for r in found.collect():
            per.setdefault(r["g"], {})[r["n"]] = (r["o"], r["id"])
        assert found.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, places in per.items():
        assert [places[n] for n in sorted(places)] == sorted((o, i) for h, o, i in rows if h == g) and set(places) == set(range(1, len(places) + 1))
    assert numbered(df.limit(0), ["g"], ["o"], "n").count() == 0


def test_structural_order_without_a_limit(spark):
    urls = [(f"https://s{i % 3}/", f"https://s{i % 3}/{'abcde'[i % 5]}/{i}") for i in range(900)]
    df = spark.createDataFrame(urls, "start string, url string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(discovery.structural_order(df, None)) == rows(discovery.structural_order(df, 10_000))


def test_site_seeds_are_cut_before_sessions_meet_them(spark):
    order = spark.createDataFrame([("s", f"https://h/{i // 2 if i < 20 else i}", i) for i in range(200)], "start string, url string, position int")
    starts = spark.createDataFrame([(1, "s"), (2, "s"), (3, "other")], "session int, start string")
    stored = spark.createDataFrame([("h/1",), ("h/30",)], "url_key string")
    seeds = crawl.site_seeds(order, starts, max_pages=12, existing=stored)
    own = [(r["url"], r["position"]) for r in seeds.filter("session = 2").orderBy("position").collect()]
    assert seeds.count() == 24 and own == [(f"https://h/{n}", 2 * n) for n in range(10) if n != 1] + [(f"https://h/{n}", n) for n in (20, 21, 22)]


def test_robots_with_very_many_rules(spark):
    """A host with a hundred thousand rules, compared with looking at each; no prefix is tested row by row."""
    import random

    rnd = random.Random(6)
    bodies = {"big.org": [f"/{rnd.randrange(10**5)}/{'x' * rnd.randrange(6)}" for _ in range(100_000)], "small.org": ["/a/", "/b", ""], "none.org": []}
    rules = spark.createDataFrame([(h, "disallow", i, v) for h, vs in bodies.items() for i, v in enumerate(vs)], "host string, kind string, pos int, value string")
    urls = [f"https://{h}/{rnd.randrange(2 * 10**5) if h == 'big.org' else rnd.choice('abc')}/{'x' * rnd.randrange(8)}" for h in bodies for _ in range(300)] + [
        "https://small.org", "https://small.org/b", "not a url", "https://BIG.org/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    allowed = discovery.robots_allows(df, rules)
    prefixes = {h: tuple(v for v in vs if v) for h, vs in bodies.items()}

    def open_(url):
        host, _, path = url.partition("://")[2].partition("/")
        path = "/" + path
        path = path[:-1] if len(path) > 1 and path.endswith("/") else path  # as paths are taken everywhere
        return not path.startswith(prefixes.get(host.lower(), ())) if host else True

    assert {r["id"] for r in allowed.collect()} == {i for i, u in enumerate(urls) if open_(u)}
    plan = allowed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "StartsWith" not in plan


def test_compaction_does_not_shuffle_rows(spark, monkeypatch, tmp_path):
    from shelfmark.sources.store import ChunkStore

    store = ChunkStore(spark, str(tmp_path / "store"))
    for a in range(3):
        store.upsert(spark.createDataFrame([(f"c{a}", f"d{a}", 0, "v", "text", [1.0])],
                                           "chunk_id string, doc_id string, chunk_index int, variant string, content string, embedding array<float>"))
    plans, write = [], ChunkStore._write
    monkeypatch.setattr(ChunkStore, "_write", lambda self, rows, *a: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(self, rows, *a)))
    store.compact("basic", "v")
    assert len(plans) == 1 and "Exchange" not in plans[0]
    assert {r["chunk_id"] for r in store.read().collect()} == {"c0", "c1", "c2"}
