"""Format detection, readers and structural grouping."""

import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import markup
from shelfmark.model import BLOCK_TYPE, ChunkingConfig, Variant
from shelfmark.operators import parsing, structural
from shelfmark.sources import readers

def T():
    return F.col("t")


def blocks(value, texts, fn):
    return value(texts, fn(T()))


@pytest.mark.parametrize("meta, raw, want", [
    ({"format": " html "}, b"", "HTML"), ({"fileName": "a.MD", "source": "x.pdf"}, b"", "MARKDOWN"),
    ({"source": "https://e.com/a/b.json?x=1#y"}, b"", "JSON"), ({"fileName": "a.bin", "contentType": "text/html; q=1"}, b"", "HTML"),
    ({"fileName": "noext"}, b"%PDF-1", "PDF"), ({}, b"PK\x03", "DOCX"), ({}, b"x", "UNKNOWN"),
    ({"format": "nonsense", "fileName": "a.txt"}, b"", "TEXT"), ({"fileName": "a.", "source": "b.pdf"}, b"", "UNKNOWN"),
    ({"source": "dir/file one.docx"}, b"", "DOCX"),
])
def test_detect_format(spark, meta, raw, want):
    df = spark.createDataFrame([(meta, raw)], "metadata map<string,string>, raw binary")
    assert parsing.detect_format(df, raw="raw").first()["format"] == want


def test_json_blocks(value):
    texts = ['[{"name":"Oak"},[1,2],"x",3]', '{"a":1,"user":{"name":"Oak"},"b":"q\\"t","c":null,"tags":["x","[y"]}',
             '"hello"', "{not json", "  ", "null"]
    got = blocks(value, texts, parsing.json_blocks)
    assert [(b["type"], b["content"], b["location"]["json_path"]) for b in got[0]] == [
        ("JSON_OBJECT", '{"name":"Oak"}', "$[0]"), ("JSON_ARRAY", "[1,2]", "$[1]"),
        ("JSON_OBJECT", "x", "$[2]"), ("JSON_OBJECT", "3", "$[3]")]
    assert [(b["content"], b["section_path"], b["location"]["json_path"]) for b in got[1]] == [
        ('{"a":1}', [], "$"), ('{"name":"Oak"}', ["user"], "$.user"), ('{"b":"q\\"t","c":null}', [], "$"),
        ("x", ["tags"], "$.tags[0]"), ("[y", ["tags"], "$.tags[1]")]
    assert got[2][0]["content"] == '"hello"'
    assert got[3] is None and got[4] is None and got[5] is None


def test_markdown_blocks(value):
    text = ("# Kettle\nIntro *text*.\n\n## Wiring\nInstall it.\n\n```java title\nint x = 1;\n```\n\n"
            "| Sort | Sum |\n| ---- | --- |\n| Oak  | 36  |\n\n- first\n- nether `c`\n\n> quoted text\n\nTop\n===\n\n    code\n")
    got = [(b["type"], b["content"], b["section_path"]) for b in blocks(value, [text], parsing.markdown_blocks)[0]]
    assert got == [
        ("HEADING", "Kettle", ["Kettle"]), ("PARAGRAPH", "Intro text.", ["Kettle"]),
        ("HEADING", "Wiring", ["Kettle", "Wiring"]), ("PARAGRAPH", "Install it.", ["Kettle", "Wiring"]),
        ("CODE", "int x = 1;", ["Kettle", "Wiring"]), ("TABLE", "Sort | Sum\nOak | 36", ["Kettle", "Wiring"]),
        ("LIST", "first\nnether c", ["Kettle", "Wiring"]), ("QUOTE", "«quoted text»", ["Kettle", "Wiring"]),
        ("HEADING", "Top", ["Top"]), ("CODE", "code", ["Top"])]
    meta = [b["metadata"] for b in blocks(value, [text], parsing.markdown_blocks)[0]]
    assert meta[4] == {"codeLanguage": "java"} and meta[0] == {}


def test_html_document_blocks():
    html = ("<html><head><title> T </title></head><body><nav>no</nav><h1>Kettle</h1><h2>Wiring</h2><p>Install <b>it</b>.<p>Next"
            "<div class='page'><p>upper leaf</p></div><div class='page'><p>nether</p></div>"
            "<table><tr><th>Sort<th>Sum</tr><tr><td>Oak<td>36</table><ul><li>one<li>two</ul>"
            "<pre data-language='python'>brew(7)\n  x</pre><blockquote>q</blockquote><script>x()</script></body></html>")
    got = markup.html_document(html)
    assert [(b["type"], b["content"]) for b in got] == [
        ("TITLE", "T"), ("HEADING", "Kettle"), ("HEADING", "Wiring"), ("PARAGRAPH", "Install it."), ("PARAGRAPH", "Next"),
        ("PARAGRAPH", "upper leaf"), ("PARAGRAPH", "nether"), ("TABLE", "Sort | Sum\nOak | 36"), ("LIST", "one\ntwo"),
        ("CODE", "brew(7)\n  x"), ("QUOTE", "q")]
    assert got[3]["section_path"] == ["Kettle", "Wiring"]
    assert [b["location"]["page"] for b in got[5:7]] == [1, 2]
    assert got[7]["metadata"] == {"tableHeader": "Sort | Sum"} and got[9]["metadata"] == {"codeLanguage": "python"}
    assert markup.html_document("<body>plain words</body>")[0]["content"] == "plain words"
    heads = markup.html_document("<body><p>Introduction</p><p>Body text.</p></body>", heuristic=True)
    assert [b["type"] for b in heads] == ["HEADING", "PARAGRAPH"] and heads[1]["section_path"] == ["Introduction"]


def test_container_keeps_its_own_section():
    got = markup.html_document("<body><h1>A</h1><div><h2>B</h2><p>in</p></div><p>out</p></body>")
    assert [b["section_path"] for b in got if b["type"] == "PARAGRAPH"] == [["A", "B"], ["A"]]


def test_page_skips_aside_and_footer_and_finds_links(spark):
    html = ("<title>P</title><body><nav><a href='/a'>a</a><a href='#x'>x</a><a href='/a'>a</a></nav><aside>no</aside>"
            "<div class='sidebar'><a href='c/d'>d</a></div><main><p>yes <a href='http://o.org/z'>z</a></p></main>"
            "<p role=navigation><a href='/n'>n</a></p><footer>no</footer></body>")
    pages = readers.read_pages(spark.createDataFrame([(1, "https://e.com/g/i.html", html)], "page_id long, url string, html string"))
    r = pages.first()
    assert r["links"] == ["https://e.com/a", "https://e.com/g/i.html#x", "https://e.com/a", "https://e.com/g/c/d", "http://o.org/z", "https://e.com/n"]
    assert r["nav_links"] == ["https://e.com/a", "https://e.com/g/c/d", "https://e.com/n"]
    assert [b["content"] for b in r["blocks"]] == ["P", "d", "yes z", "n"]
    doc = readers.page_to_document(pages).first()
    assert doc["metadata"] == {"sourceType": "web", "source": "https://e.com/g/i.html", "format": "HTML", "title": "P"}


def test_page_without_blocks_becomes_a_paragraph(spark):
    df = spark.createDataFrame([(1, "u", "", "all text", [])], f"page_id int, url string, title string, text string, blocks array<{BLOCK_TYPE}>")
    doc = readers.page_to_document(df).first()
    assert [(b["type"], b["content"]) for b in doc["blocks"]] == [("PARAGRAPH", "all text")]
    assert "title" not in doc["metadata"]


def test_parse_routes_and_rejects(spark):
    docs = spark.createDataFrame([
        (1, '{"a":1}', {"fileName": "a.json"}, None), (2, "{bad", {"fileName": "b.json"}, None),
        (3, "", {"fileName": "c.md"}, b"# Hi\n\ntext"), (4, "plain", {}, None), (5, " ", {}, None)],
        "doc_id long, text string, metadata map<string,string>, raw binary")
    ok, rejected = parsing.reject_empty(parsing.parse(docs, raw="raw"))
    kinds = {r["doc_id"]: (r["source_type"], len(r["blocks"])) for r in ok.collect()}
    assert kinds == {1: ("JSON", 1), 3: ("MARKDOWN", 2), 4: ("TEXT", 1)}
    reasons = {r["doc_id"]: r["reject_reason"] for r in rejected.collect()}
    assert reasons == {2: "Failed to parse JSON document 2", 5: "No text could be extracted from document 5"}


def block(kind, content, section=(), page=None, meta=None):
    return (kind, content, list(section), (page, None, None, None, None), meta or {})


def grouped(spark, items, config=ChunkingConfig(), limit=1000, json=False):
    df = spark.createDataFrame([(items,)], f"blocks array<{BLOCK_TYPE}>")
    fold = structural.group_json if json else structural.group_sections
    return df.select(fold(F.col("blocks"), config, limit).alias("g")).first()["g"]


def test_group_sections(spark):
    g = grouped(spark, [block("HEADING", "A", ["A"]), block("PARAGRAPH", "one", ["A"]), block("PARAGRAPH", "two", ["A"]),
                        block("TABLE", "t", ["A"]), block("LIST", "l", ["A"]), block("HEADING", "B"), block("PARAGRAPH", "three")])
    assert [(x["text"], x["content_type"], x["context"], x["is_protected"]) for x in g] == [
        ("one\n\ntwo", "PARAGRAPH", "A", False), ("t", "TABLE", "A", True), ("l", "LIST", "A", False), ("three", "PARAGRAPH", "B", False)]


def test_group_sections_by_page_size_and_settings(spark):
    pages = [block("PARAGRAPH", "a", page=1), block("PARAGRAPH", "b", page=1), block("PARAGRAPH", "c", page=2)]
    assert [x["text"] for x in grouped(spark, pages)] == ["a\n\nb", "c"]
    # The limit is tested after adding, and separators count.
    sized = [block("PARAGRAPH", "abc"), block("PARAGRAPH", "de"), block("PARAGRAPH", "f")]
    assert [x["text"] for x in grouped(spark, sized, limit=5)] == ["abc\n\nde", "f"]
    loose = ChunkingConfig(preserve_tables=False, preserve_code=False, respect_section_boundaries=False)
    mixed = [block("PARAGRAPH", "p", ["S"]), block("TABLE", "t", ["S"]), block("CODE", "c", ["S"])]
    assert [(x["text"], x["context"]) for x in grouped(spark, mixed, loose)] == [("p\n\nt\n\nc", "S")]
    # A path of its own that differs from the held section always flushes first.
    strict = grouped(spark, [block("PARAGRAPH", "p", ["S"]), block("PARAGRAPH", "q", ["S"])])
    assert [(x["text"], x["context"]) for x in strict] == [("p", ""), ("q", "")]


def test_group_json(spark):
    rows = [block("JSON_OBJECT", c) for c in ("a", "b", "c")]
    two = ChunkingConfig(max_records_per_chunk=2)
    assert [x["text"] for x in grouped(spark, rows, two, json=True)] == ["a\n\nb", "c"]
    paths = [block("JSON_ARRAY", "a", ["x"]), block("JSON_ARRAY", "b", ["y"]), block("JSON_OBJECT", "c", ["y"])]
    assert [(x["text"], x["content_type"]) for x in grouped(spark, paths, json=True)] == [("a", "JSON_ARRAY"), ("b\n\nc", "JSON_OBJECT")]


def test_structural_chunks_carry_context(spark):
    items = [block("HEADING", "Kettle", ["Kettle"]), block("PARAGRAPH", "word " * 40, ["Kettle"], 3, {"k": "v"})]
    df = spark.createDataFrame([(1, "HTML", {"source": "s", "rawBytes": "x"}, items)],
                               f"doc_id long, source_type string, metadata map<string,string>, blocks array<{BLOCK_TYPE}>")
    for strategy in ("recursive", "semantic"):
        rows = structural.chunk_structural(df, Variant("v", strategy, 60, 10)).orderBy("chunk_index").collect()
        assert len(rows) > 2 and all(r["content"].startswith("Kettle\n\n") for r in rows)
        assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
        assert rows[0]["metadata"] == {"k": "v", "source": "s", "strategy": strategy, "maxChunkSize": "60", "format": "HTML",
                                       "contentType": "PARAGRAPH", "sectionPath": "Kettle", "page": "3"}


def test_effective_max_chars():
    assert ChunkingConfig(max_tokens=10).effective_max_chars(100) == 40
    assert ChunkingConfig().effective_max_chars(100) == 100
    with pytest.raises(ValueError):
        ChunkingConfig(max_records_per_chunk=0)


def test_sitemap_robots_catalog(spark):
    bodies = spark.createDataFrame([
        ("a", "<sitemapindex><sitemap><loc> x </loc></sitemap></sitemapindex>"), ("b", "<urlset><loc>y"),
        ("c", "<!DOCTYPE r [<!ENTITY e 'z'>]><urlset><loc>&e;</loc></urlset>"), ("d", "<urlset><url><loc>1</loc></url><url><loc>2</loc></url></urlset>")],
        "url string, body string")
    got = [tuple(r) for r in readers.read_sitemaps(bodies).orderBy("url", "pos").collect()]
    assert got == [("a", True, 0, "x"), ("d", False, 0, "1"), ("d", False, 1, "2")]
    robots = spark.createDataFrame([("h", "User-agent: Googlebot\nDisallow: /g\nUser-Agent: *\r\nDisallow: /a # c\nDisallow:\nAllow: /b\nsitemap: http://h/s.xml\nbroken")],
                                   "host string, body string")
    assert [(r["kind"], r["value"]) for r in readers.read_robots(robots).orderBy("pos").collect()] == [
        ("disallow", "/a"), ("disallow", ""), ("sitemap", "http://h/s.xml")]
    catalog = spark.createDataFrame([('{"p":{"api":"u","env":["K"],"models":{"m":{"cost":{"input":1.5}},"n":{"name":"N","reasoning":true,"limit":{"context":9}}}},"q":{}}',)], "body string")
    rows = {r["model_id"]: r for r in readers.flatten_catalog(catalog).collect()}
    assert rows["m"]["name"] == "m" and rows["m"]["cost_input"] == 1.5 and rows["m"]["context_limit"] == 0 and rows["m"]["reasoning"] is False
    assert rows["n"]["context_limit"] == 9 and rows["n"]["api_key_env"] == "K"


def test_read_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "sub" / "b.md").write_bytes(b"# x")
    (tmp_path / ".hidden").write_bytes(b"no")
    rows = {r["metadata"]["source"]: r for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "sub/b.md"} and rows["sub/b.md"]["metadata"]["fileName"] == "b.md"
    assert rows["a.txt"]["metadata"]["contentHash"] == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"


def test_read_folder_hashes_files_too_large_for_one_value(spark, tmp_path, monkeypatch):
    """Larger files than Spark gives as one value, here 100 bytes, are hashed line by line, whatever their bytes and names."""
    rnd = np.random.default_rng(2)
    noise, mark = rnd.integers(0, 256, 300_000, dtype=np.uint8).tobytes(), b"\xef\xbb\xbf"
    files = {"noise.parquet": noise, "noise": noise + b"\n", "packed.gz": gzip.compress(noise), "not packed.bz2": noise[:5000], "x.snappy": b"\n" * 500,
             "mark.txt": mark + b"one\r\n\ntwo\n" * 40, "mark.zst": mark + b"x" * 200, "marks": mark * 200 + b"\n", "one line": b"y, " * 50_000, "zeros": bytes(30_000) + b"n" * 9000 + bytes(9), "runs.txt": b"x" * 19_000 + b"0" + b"z" * 18_000,
             "sub/a=1/f [1]{a,b}*?%20 \\.txt": b"\xff\x00\n" * 99, "small.txt": b"hello", "a.b ": noise}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(readers, "WHOLE_BYTES", 100, raising=False)
    monkeypatch.setattr(readers, "LINE_BYTES", 20_000, raising=False)
    settings = {"spark.sql.sources.binaryFile.maxLength": "100", "spark.sql.files.maxPartitionBytes": "64k"}
    kept = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = readers.read_folder(spark, str(tmp_path)).select("metadata")
        rows = {r[0]["source"]: r[0]["contentHash"] for r in found.collect()}
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert rows == {name: hashlib.sha256(data).hexdigest() for name, data in files.items()}
    # No separator cuts this one, so it is taken as one value.
    (tmp_path / "uncut.txt").write_bytes(b"y" * 50_000)
    files["uncut.txt"] = b"y" * 50_000
    found = readers.read_folder(spark, str(tmp_path)).select("metadata", "raw", "bytes").collect()
    assert {r[0]["source"]: (bytes(r[1]), r[2]) for r in found} == {name: (data, len(data)) for name, data in files.items()}
    assert {r[0]["source"]: r[0]["contentHash"] for r in found} == {name: hashlib.sha256(data).hexdigest() for name, data in files.items()}


def test_read_documents(spark):
    df = spark.createDataFrame([("t", {"title": "x"}, None), ("", {"fileName": "f"}, b"1"), (" ", None, None), ("u", None, None)],
                               "text string, metadata map<string,string>, raw binary")
    ok, rejected = readers.read_documents(df, raw="raw")
    assert [r["metadata"]["title"] for r in ok.collect()] == ["x", "f", "Untitled document"]
    assert rejected.count() == 1


def test_only_closed_references_are_resolved():
    html = "<title>A &amp; B&amp</title><p>x &copy; &copy y &#38 &#38; <a href='/m?a=1&amp;b=2&copy=3'>z</a>"
    page = markup.web_page(html, "https://e.com/")
    assert page["title"] == "A & B&amp"
    assert page["blocks"][1]["content"] == "x \u00a9 &copy y &#38 & z"
    assert page["links"] == ["https://e.com/m?a=1&b=2&copy=3"]


def test_readers_give_results_every_few_rows():
    import pyarrow as pa

    texts = [f"<p>{i}" if i % 7 else None for i in range(1000)]
    found = list(parsing._batched("array<string>", lambda t: [t]).func(iter([pa.array(texts)])))
    assert max(map(len, found)) == parsing.STEP
    assert [x for part in found for x in part.to_pylist()] == [t and [t] for t in texts]
