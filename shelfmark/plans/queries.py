"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import splitters, urls as U
from ..functions.links import link_pages
from ..functions.embedders import ModelEmbedder
from ..functions.text import simple_upper, unnest
from ..functions.vectors import cosine
from ..operators import (chunking, conversations, crawl, discovery, duplicates, evaluation, inspection,
                         parsing, planning, ranking, structural, telemetry, vector_search)
from ..operators.ann import recall
from ..operators.lexical_index import lexical_search
from ..operators.packing import pack_rows
from ..sources import readers, store as sinks
from ..session import fresh_dir, materialize, ship_package, spread
from ..streaming import jobs as streams
from .tables import CELLS, FIXED, RECURSIVE, SEMANTIC, TOKEN, VARIANTS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(Tables(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# Sources and sinks

@query
def read_folder(t):
    docs = readers.read_folder(t.spark, t.sf_dir)
    m = F.col("metadata")
    return docs.select("doc_id", m["source"].alias("source"), m["fileName"].alias("file_name"),
                       m["contentHash"].alias("content_hash"), "bytes")


@query
def read_documents(t):
    accepted, rejected = readers.read_documents(t.docs().withColumn(
        "metadata", F.map_filter("metadata", lambda k, v: (k != "title") | (F.col("lang") == "en"))))
    return accepted.select("doc_id", F.col("metadata")["title"].alias("title"), F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rejected.select("doc_id", F.lit(None).cast("string").alias("title"), "reject_reason"))


@query
def read_pages(t):
    return readers.read_pages(t.pages).select(
        "page_id", "url", "title", *[n.cast("bigint").alias(a) for a, n in (
            ("text_chars", F.length("text")), ("links", F.size("links")), ("nav_links", F.size("nav_links")),
            ("blocks", F.size("blocks")))])


@query
def page_to_document(t):
    docs = readers.page_to_document(readers.read_pages(t.pages))
    return docs.select("doc_id", "source_type", F.col("metadata")["source"].alias("source"),
                       F.col("metadata")["title"].alias("title"), F.size("blocks").cast("bigint").alias("blocks"))


@query
def flatten_catalog(t):
    model = F.named_struct(
        F.lit("name"), F.when(F.col("p_size") > 25, F.col("p_name")),
        F.lit("limit"), F.named_struct(F.lit("context"), F.col("p_size")),
        F.lit("cost"), F.named_struct(F.lit("input"), F.col("p_retailprice")))
    body = F.to_json(F.create_map(F.col("p_brand"), F.named_struct(
        F.lit("api"), F.concat(F.lit("https://"), F.col("p_brand")), F.lit("env"), F.array(F.lit("KEY"), F.lit("ALT")),
        F.lit("models"), F.create_map(F.col("p_partkey").cast("string"), model))))
    return readers.flatten_catalog(t.part.select(body.alias("body")))


@query
def read_sitemaps(t):
    site = U.origin(F.col("url"))
    body = F.concat(F.lit("<urlset><url><loc>"), F.col("url"), F.lit("</loc></url><url><loc> "), site,
                    F.lit("/about </loc></url></urlset>"))
    return readers.read_sitemaps(t.pages.select("url", body.alias("body"))).select(
        "url", "is_index", *big("pos"), "loc")


def _robots(t):
    body = F.concat(
        F.lit("# rules\nUser-agent: *\nDisallow: /"), F.split(F.col("url"), "/")[3],
        F.lit("/ # closed\nSitemap: "), U.origin(F.col("url")),
        F.lit("/map.xml\nUser-agent: other\nDisallow: /\n"))
    return t.pages.select(F.concat(U.host(F.col("url")), F.lit("#"), F.col("page_id")).alias("host"), body.alias("body"))


@query
def read_robots(t):
    return readers.read_robots(_robots(t)).select("host", "kind", *big("pos"), "value")


@query
def upsert_chunks(t):
    """French chunks come again twice, in lower and then in upper case, with some new ones; the last counts."""
    old = t.chunks().select("chunk_id", "doc_id", "chunk_index", "content")
    french = t.chunks().filter("lang = 'fr'").select("chunk_id", "doc_id", "chunk_index", "content")
    fresh = french.withColumn("content", F.lower("content")).withColumn("seq", F.lit(1)).unionByName(
        french.withColumn("content", simple_upper(F.col("content"))).withColumn("seq", F.lit(2)))
    extra = fresh.withColumn("chunk_id", F.concat("chunk_id", F.lit("-new")))
    return sinks.upsert(old, fresh.unionByName(extra)).select("chunk_id", "doc_id", *big("chunk_index"), "content")


@query
def delete_document(t):
    gone = t.labels.filter("toxic = 1").select("doc_id")
    return sinks.delete_documents(t.chunks().select("chunk_id", "doc_id", "chunk_index"), gone).select(
        "chunk_id", "doc_id", *big("chunk_index"))


@query
def delete_orphans(t):
    labelled = t.chunks().join(t.labels.select(F.col("doc_id").alias("owner")), F.col("doc_id") == F.col("owner"), "left")
    return sinks.delete_orphans(labelled.select("chunk_id", F.col("owner").alias("doc_id")))


@query
def variant_store(t):
    """Upserts of three variants, one of them repeated in part, a drop, a delete and a compaction."""
    store = sinks.ChunkStore(t.spark, fresh_dir(t.spark, "store"), boot=(FIXED.module, FIXED.variant_id))
    # Stored three times, embedded once: the first batch is where the others are read from.
    store.upsert(chunking.embed_chunks(t.chunks(FIXED)).drop("lang", "source"), module=FIXED.module)
    rows = store.read(FIXED.module, FIXED.variant_id).drop("module")
    store.upsert(chunking.embed_chunks(t.chunks(TOKEN)).drop("lang", "source"), module=TOKEN.module)
    store.upsert(rows, module="advanced")
    store.upsert(rows.filter("chunk_index = 0"), module=FIXED.module)
    store.drop_variant("basic", TOKEN.variant_id)
    store.delete(t.labels.filter("toxic = 1").select("doc_id"))
    store.compact("advanced", FIXED.variant_id)
    return store.read().groupBy("module", "variant").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("documents"))


# Parsing

@query
def detect_format(t):
    pages = t.pages.select(
        "page_id", "url", F.create_map(F.lit("source"), F.col("url"), F.lit("contentType"), F.when(
            F.col("url").contains("utm_"), F.lit("text/markdown; charset=utf-8")).otherwise(F.lit(""))).alias("metadata"))
    return parsing.detect_format(pages).select("page_id", "format")


def _mixed(t):
    """Documents of three formats in one table."""
    page = t.pages.select(F.concat(F.lit("page-"), F.col("page_id")).alias("doc_id"), F.col("html").alias("text"),
                          F.create_map(F.lit("contentType"), F.lit("text/html")).alias("metadata"))
    event = spread(t.events).select(F.concat(F.lit("event-"), F.col("event_id")).alias("doc_id"), F.col("props").alias("text"),
                            F.create_map(F.lit("fileName"), F.lit("props.json")).alias("metadata"))
    turn = t.conversations.select(
        F.concat(F.lit("turn-"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("doc_id"),
        F.concat(F.lit("# "), F.col("role"), F.lit("\n\n"), F.col("text")).alias("text"),
        F.create_map(F.lit("format"), F.lit("markdown")).alias("metadata"))
    doc = t.documents.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("doc_id"), "text",
                             F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    return page.unionByName(event).unionByName(turn).unionByName(doc)


@query
def dispatch_parse(t):
    ok, rejected = parsing.reject_empty(parsing.parse(_mixed(t)))
    return ok.select("doc_id", "source_type", F.size("blocks").cast("bigint").alias("blocks"),
                     F.length(parsing.text_of(F.col("blocks"))).cast("bigint").alias("chars"))


@query
def plain_blocks(t):
    parsed = t.documents.select("doc_id", parsing.plain_blocks(F.col("text")).alias("blocks"))
    return parsing.explode_blocks(parsed).select("doc_id", *big("block_idx"), "type", F.md5("content").alias("digest"))


@query
def json_blocks(t):
    parsed = spread(t.events).select(F.col("event_id").alias("doc_id"), parsing.json_blocks(F.col("props")).alias("blocks"))
    return parsing.explode_blocks(parsed).select(
        "doc_id", *big("block_idx"), "type", "content", F.col("location.json_path").alias("json_path"))


def _json_lines(t):
    """Each document as a JSON object: scalars, a list of its lines, a nested object."""
    body = F.to_json(F.struct(
        F.col("lang"), F.col("source"), F.split(F.col("text"), "\n").alias("lines"),
        F.struct(F.col("n_chars").alias("size")).alias("stats"), F.col("n_chars").alias("last")))
    return t.documents.select("doc_id", F.lit("JSON").alias("source_type"),
                              F.expr("cast(map() as map<string,string>)").alias("metadata"),
                              parsing.json_blocks(body).alias("blocks"))


@query
def json_document_blocks(t):
    return parsing.explode_blocks(_json_lines(t)).select(
        "doc_id", *big("block_idx"), "type", "content", F.array_join("section_path", " > ").alias("section"),
        F.col("location.json_path").alias("json_path"))


@query
def markdown_blocks(t):
    turns = t.conversations.select(
        F.col("conv_id").alias("doc_id"), "turn",
        parsing.markdown_blocks(F.concat(F.lit("# Turn\n\n## "), F.col("role"), F.lit("\n\n"), F.col("text"))).alias("blocks"))
    return parsing.explode_blocks(turns, ["turn"]).select(
        "doc_id", "turn", *big("block_idx"), "type", "content", F.array_join("section_path", " > ").alias("section"))


@query
def html_blocks(t):
    parsed = t.pages.select(F.col("page_id").alias("doc_id"), parsing.html_blocks(F.col("html")).alias("blocks"))
    return parsing.explode_blocks(parsed).select(
        "doc_id", *big("block_idx"), "type", "content", F.array_join("section_path", " > ").alias("section"),
        F.col("location.page").alias("page"), F.col("location.dom_path").alias("dom_path"))


@query
def heuristic_headings(t):
    parsed = t.documents.select("doc_id", parsing.heading_blocks(F.split("text", "\n")).alias("blocks"))
    return parsing.explode_blocks(parsed).select(
        "doc_id", *big("block_idx"), "type", "content", F.array_join("section_path", " > ").alias("section"))


@query
def page_blocks(t):
    pages = readers.read_pages(t.pages).select(F.col("page_id").alias("doc_id"), "blocks")
    return parsing.explode_blocks(pages).select(
        "doc_id", *big("block_idx"), "type", "content", F.array_join("section_path", " > ").alias("section"))


@query
def page_links(t):
    return unnest(link_pages(t.pages), ["page_id"], "links", "pos", "link").select(
        "page_id", *big("pos"), "link")


@query
def nav_links(t):
    return unnest(link_pages(t.pages), ["page_id"], "nav_links", "pos", "link").select(
        "page_id", *big("pos"), "link")


@query
def reject_empty(t):
    """Words of the benchmark removed, so that a document may end up blank."""
    parsed = t.documents.select("doc_id", parsing.plain_blocks(
        F.regexp_replace("text", "[A-Za-z0-9]", "")).alias("blocks"))
    ok, rejected = parsing.reject_empty(parsed)
    return ok.select("doc_id", F.lit("ok").alias("state")).unionByName(
        rejected.select("doc_id", F.col("reject_reason").alias("state")))


# Chunking

def _chunk_columns(df, *extra):
    return df.select("chunk_id", "doc_id", *big("chunk_index"), "content", *extra)


@query
def chunk_fixed(t):
    return _chunk_columns(t.chunks(), *big("start_pos", "end_pos"))


@query
def chunk_token(t):
    return _chunk_columns(t.chunks(TOKEN), *big("token_count"))


@query
def chunk_recursive(t):
    return _chunk_columns(t.chunks(RECURSIVE))


@query
def chunk_semantic(t):
    return _chunk_columns(t.chunks(SEMANTIC))


@query
def densify(t):
    drafts = splitters.densify(splitters._plain(F.split(F.col("text"), "\n")))
    return unnest(t.documents, ["doc_id"], drafts, "chunk_index", "d").select(
        "doc_id", *big("chunk_index"), F.col("d.content").alias("content"))


@query
def overlap_prefix(t):
    texts = splitters.overlap_prefix(F.split(F.col("text"), "\n"), 24)
    return unnest(t.documents, ["doc_id"], texts, "pos", "content").select(
        "doc_id", *big("pos"), "content")


def _sectioned(t):
    return t.documents.select(
        "doc_id", F.lit("TEXT").alias("source_type"), F.expr("cast(map() as map<string,string>)").alias("metadata"),
        parsing.heading_blocks(F.split("text", "\n")).alias("blocks"))


def _groups(df):
    return unnest(df, ["doc_id"], "groups", "group_idx", "g").select(
        "doc_id", *big("group_idx"), F.col("g.text").alias("text"), F.col("g.content_type").alias("content_type"),
        F.col("g.context").alias("context"))


@query
def group_sections(t):
    return _groups(structural.with_groups(_sectioned(t), FIXED))


@query
def group_json(t):
    return _groups(structural.with_groups(_json_lines(t), FIXED))


@query
def chunk_structural(t):
    pages = readers.page_to_document(readers.read_pages(t.pages))
    return structural.chunk_structural(pages, RECURSIVE).select(
        "chunk_id", "doc_id", *big("chunk_index"), "content", "content_type",
        F.array_join("section_path", " > ").alias("section"))


@query
def chunk_dispatch(t):
    ok, _ = parsing.reject_empty(parsing.parse(_mixed(t)))
    return structural.chunk_structural(ok, RECURSIVE).select(
        "chunk_id", "doc_id", *big("chunk_index"), "format", "content_type", F.length("content").alias("chars"))


@query
def pack_lines(t):
    """Lines of each document packed by the table function, as rows."""
    lines = unnest(t.documents, ["doc_id"], F.split("text", "\n"), "line", "content")
    return pack_rows(lines, "doc_id", "line", "content", 512).select("doc_id", "piece_index", "content")


@query
def chunk_variants(t):
    return chunking.chunk_variants(t.docs(), [FIXED, TOKEN]).select(
        "variant", "chunk_id", "doc_id", *big("chunk_index"), F.md5("content").alias("digest"))


@query
def compare_chunking(t):
    return chunking.compare_chunking(t.documents, VARIANTS, baseline=RECURSIVE.variant_id)


# Embedding

def _letters_model():
    import numpy as np

    def model(texts):
        out = np.zeros((len(texts), 26), dtype=np.float32)
        for i, text in enumerate(texts):
            raw = np.frombuffer(text.lower().encode("ascii", "ignore"), dtype=np.uint8)
            out[i] = np.bincount(raw[(raw >= 97) & (raw <= 122)] - 97, minlength=26)
        return out

    return model


@query
def embed(t):
    """A Python model behind the embedder port: letter counts, 32 texts at a time."""
    e = ModelEmbedder(_letters_model, batch_size=32).embed(F.col("text"))
    return unnest(t.documents, ["doc_id"], e, "dim", "value").select("doc_id", *big("dim"), F.col("value").cast("bigint").alias("value"))


@query
def hashing_embedding_query(t):
    v = unnest(t.store(), ["chunk_id"], "embedding", "dim", "value").filter("value > 0")
    return v.select("chunk_id", *big("dim"), F.col("value").cast("bigint").alias("value"))


@query
def check_embeddings(t):
    return vector_search.check_embeddings(t.vectors()).select(*big("dimensions"), "total_chunks")


# Retrieval

@query
def cosine_neighbours(t):
    e = t.embeddings
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def _hits(df, *extra):
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), *big("rank"), *extra)


@query
def knn(t):
    return _hits(vector_search.knn(t.vector_questions(), t.vectors(), 10))


@query
def knn_in_document(t):
    return _hits(vector_search.knn(
        t.vector_questions().withColumn("scope", F.col("label")), t.vectors(), 5))


@query
def fetch_size(t):
    k = (F.col("p_size") * 7 - 20).cast("int")
    return t.part.select("p_partkey", *[vector_search.fetch_size_column(k).cast("bigint").alias("fetch")])


def _search(t, k, **kw):
    return ranking.search(t.asked(), t.store(), k, **kw)


@query
def dedup_hits(t):
    """Every text hit once per question: documents grouped by language stand for hits."""
    d = t.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("chunk_id"),
                           F.lower("text").alias("content"), (F.col("doc_id") + 1).alias("rank"))
    return ranking.dedup_hits(d).select("query_id", "chunk_id", *big("rank"))


@query
def search(t):
    return _hits(_search(t, 5))


@query
def metadata_filter(t):
    found = _search(t, 20, columns=["doc_id", "chunk_index", "metadata"])
    return _hits(ranking.metadata_filter(found, {"lang": "en", "strategy": "fixed"}))


@query
def bm25(t):
    found = _search(t, 20)
    return ranking.bm25(found, t.questions()).select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"))


@query
def bm25_corpus(t):
    """The ten best documents of the whole corpus for every benchmark question, by an inverted index."""
    return lexical_search(t.spark, t.lexical_index(), t.questions(), 10).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), *big("rank"))


@query
def rrf(t):
    ranked = ranking.rrf(ranking.bm25(_search(t, 20), t.questions()))
    return ranked.select("query_id", "chunk_id", *big("lexical_rank"), F.round("rrf", 9).alias("rrf"))


@query
def hybrid_search(t):
    hits = ranking.hybrid_search(t.asked(), t.store(), 5, where={"lang": "en"})
    return hits.select("query_id", "chunk_id", *big("rank"), "fused")


@query
def search_with_keyword(t):
    return vector_search.search_with_keyword(t.store(), "THE ").select(
        "chunk_id", "doc_id", *big("chunk_index"), "content_preview", F.round("distance", 6).alias("distance"))


@query
def pairwise_distance(t):
    return vector_search.pairwise_distance(t.vectors(), 15).select(
        "chunk_a", "chunk_b", F.round("distance", 6).alias("distance"))


@query
def ivf_search_query(t):
    return _hits(t.vector_index().search(t.vector_questions(), 10, nprobe=12))


@query
def ivf_full_probe(t):
    """With every cell probed the index gives what an exact search gives."""
    return _hits(t.vector_index().search(t.vector_questions(), 10, nprobe=CELLS, refine=None))


@query
def ivf_recall(t):
    found = t.vector_index().search(t.vector_questions(), 10, nprobe=12)
    return recall(found, vector_search.knn(t.vector_questions(), t.vectors(), 10))


@query
def plan_subqueries(t):
    return planning.plan_subqueries(t.questions()).select("query_id", *big("step"), "subquery")


@query
def multi_step_search(t):
    found = planning.multi_step_search(t.questions(), t.store(), 3)
    return _hits(found, *big("step"))


@query
def merge_sources(t):
    merged = planning.gather_sources(t.questions(), t.store(), 3)
    return merged.select("query_id", "chunk_id", *big("step", "rank", "position"))


@query
def build_context(t):
    found = _search(t, 3).filter(F.col("score") > 0.6)
    return ranking.build_context(found, t.questions()).select("query_id", "context", *big("sources"), "prompt")


@query
def search_with_default_k(t):
    asked = t.vector_questions().withColumn("k", F.when(F.col("label") < 5, F.col("label")))
    named = t.vectors().withColumn("content", F.concat(F.lit("Text "), F.col("chunk_id")))
    return _hits(ranking.search(asked, named))


# Inspection

@query
def list_documents(t):
    return inspection.list_documents(t.chunks(), ["chunk_id", "lang"])


@query
def chunks_per_document(t):
    return inspection.chunks_per_document(t.chunks())


@query
def document_titles(t):
    titled = t.chunks().withColumn("title", F.col("metadata")["title"])
    return inspection.document_titles(titled)


@query
def metadata_keys(t):
    return inspection.metadata_keys(t.chunks())


def _with_orphans(t):
    """Chunks whose document is unknown when it has no label, and '' when it is toxic."""
    owner = t.labels.select(F.col("doc_id").alias("_id"), F.when(F.col("toxic") == 1, F.lit("")).otherwise(
        F.col("doc_id").cast("string")).alias("owner"))
    c = t.chunks().select("chunk_id", F.col("doc_id").alias("_doc"))
    return c.join(owner, F.col("_doc") == F.col("_id"), "left").select("chunk_id", F.col("owner").alias("doc_id"))


@query
def orphan_chunks(t):
    return inspection.orphan_chunks(_with_orphans(t))


@query
def table_counts(t):
    return inspection.table_counts({"ingestion_jobs": t.events, "documents": t.documents, "chunks": t.chunks()})


@query
def vector_dims(t):
    return inspection.vector_dims(t.vectors()).select(*big("dimensions"), "total_chunks")


@query
def count_by_document_having(t):
    return inspection.count_by_document_having(_with_orphans(t), "")


@query
def percentile_nearest_rank(t):
    return inspection.percentile_nearest_rank(
        t.events, ["event_type"], "value", {"p5": 5.0, "p50": 50.0, "p95": 95.0, "p100": 100.0})


def _jobs(t):
    """Latest job of every event: type tells the state, user the batch."""
    kind = F.col("event_type")
    state = F.when(kind == "error", "FAILED").when((kind == "signup") & (F.col("value") > 250.0), "RUNNING").otherwise("COMPLETED")
    return t.events.select(
        F.col("user_id").alias("batch"), F.col("event_id").alias("doc_id"), state.alias("state"),
        F.floor("value").alias("chunk_count"), F.col("props").alias("message"))


@query
def batch_summary(t):
    return inspection.batch_summary(_jobs(t))


@query
def batch_failures(t):
    return inspection.batch_failures(_jobs(t))


@query
def documents_by_store(t):
    return inspection.documents_by_store({"basic": t.chunks(FIXED), "advanced": t.chunks(TOKEN)})


@query
def bounded_top_k(t):
    best = inspection.longest_chunks(t.chunks(), 25)
    return best.select("chunk_id", *big("content_length"), "doc_id", *big("chunk_index"))


@query
def longest_chunks(t):
    best = inspection.longest_chunks(t.chunks(TOKEN), 10)
    return best.select("chunk_id", *big("content_length"), "doc_id", *big("chunk_index"))


@query
def chunk_preview(t):
    return inspection.chunk_preview(t.chunks()).select("chunk_id", "content_preview", "doc_id", *big("chunk_index"))


@query
def document_chunks(t):
    return inspection.document_chunks(t.chunks(), 7).select("chunk_id", "content_preview", *big("chunk_index"))


@query
def document_openings(t):
    """The first two chunks of every labelled document."""
    return inspection.opening_chunks(t.labels, t.chunks(), 2).select("doc_id", "quality", "chunk_id", *big("chunk_index"))


# Duplicates

@query
def content_hash_query(t):
    return duplicates.with_content_hash(t.documents).select("doc_id", "content_hash")


def _hashed(t):
    return duplicates.with_content_hash(t.documents).select("doc_id", "lang", "source", "content_hash")


@query
def find_by_content_hash(t):
    """The store in two modules by language; incoming are all documents."""
    h = _hashed(t)
    stored = duplicates.tag_stores({"basic": h.filter("lang != 'en'"), "advanced": h.filter("lang = 'en'")})
    return duplicates.find_by_content_hash(h.drop("source", "lang"), stored)


def _page_store(t):
    return t.pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("source"))


@query
def source_index(t):
    p = _page_store(t)
    stores = duplicates.tag_stores({"basic": p.filter(F.col("source").startswith("https")), "advanced": p})
    return duplicates.source_index(stores)


def _split_pages(t):
    """Pages with tracking parameters come in; the others are stored."""
    p = _page_store(t).withColumn("url_key", U.url_key(F.col("source")))
    return p.filter(~F.col("source").contains("?")), p.filter(F.col("source").contains("?"))


@query
def skip_known(t):
    stored, incoming = _split_pages(t)
    index = duplicates.source_index(duplicates.tag_stores({"basic": stored}))
    return duplicates.skip_known(incoming, index, "url_key").select("doc_id", "url_key")


@query
def override_known(t):
    stored, incoming = _split_pages(t)
    index = duplicates.source_index(duplicates.tag_stores({"basic": stored}))
    kept, new = duplicates.override_known(incoming, index, stored, "url_key")
    return kept.select("doc_id", "url_key", F.lit("kept").alias("state")).unionByName(
        new.select("doc_id", "url_key", F.lit("ingested").alias("state")))


@query
def dedup_in_batch(t):
    return duplicates.dedup_in_batch(_hashed(t)).select("doc_id", "content_hash")


@query
def existing_sources(t):
    return duplicates.existing_sources(_page_store(t))


# URLs and crawling

@query
def url_key(t):
    return t.pages.select("page_id", U.url_key(F.col("url")).alias("url_key"), U.host(F.col("url")).alias("host"))


@query
def canonical_url(t):
    return t.page_urls().select("page_id", U.canonical_url(F.col("url"), F.col("start")).alias("canonical"))


@query
def in_scope(t):
    en = F.concat(U.origin(F.col("url")), F.lit("/en/"))
    return t.page_urls().select("page_id", U.in_scope(F.col("url"), en).alias("in_scope"))


@query
def select_family(t):
    return discovery.select_family(t.page_urls().select("start", "url", "pos")).select("start", "url", "pos")


@query
def structural_order(t):
    return discovery.structural_order(t.page_urls().select("start", "url"), limit=None).select(
        "start", "url", *big("position"))


@query
def robots_allows(t):
    """Sites close the language area of their lowest-numbered page."""
    first = t.pages.select(U.host(F.col("url")).alias("host"), "page_id", "url").groupBy("host").agg(
        F.min_by("url", "page_id").alias("url"))
    body = F.concat(F.lit("User-agent: *\nDisallow: /"), F.split(F.col("url"), "/")[3], F.lit("/\nDisallow:\n"))
    rules = readers.read_robots(first.select("host", body.alias("body")))
    return discovery.robots_allows(t.pages.select("page_id", "url"), rules)


@query
def expand_sitemaps(t):
    """Each site names one index in robots; it lists one sitemap per page."""
    site = t.pages.select("page_id", "url", U.host(F.col("url")).alias("host"), U.origin(F.col("url")).alias("origin"))
    robots = site.select("host", F.concat(F.lit("Sitemap: "), F.col("origin"), F.lit("/i-"), F.col("page_id"),
                                          F.lit(".xml")).alias("body"))
    wrap = lambda tag, loc: F.concat(F.lit(f"<{tag}><x><loc>"), loc, F.lit(f"</loc></x></{tag}>"))
    index = site.select(
        F.concat("origin", F.lit("/i-"), F.col("page_id"), F.lit(".xml")).alias("url"),
        wrap("sitemapindex", F.concat("origin", F.lit("/m-"), F.col("page_id"), F.lit(".xml"))).alias("body"))
    leaf = site.select(
        F.concat("origin", F.lit("/m-"), F.col("page_id"), F.lit(".xml")).alias("url"),
        wrap("urlset", F.replace("url", F.lit("&"), F.lit("&amp;"))).alias("body"))
    starts = t.page_urls().select("start").distinct()
    return discovery.expand_sitemaps(starts, readers.read_robots(robots), index.unionByName(leaf),
                                     max_urls=None, max_sitemaps=None, max_depth=None).select("start", "url")


@query
def discover(t):
    """Every page taken as a file in the root of its site, so that its menu is in scope."""
    moved = t.pages.withColumn("url", F.concat(U.origin(F.col("url")), F.lit("/p"), F.col("page_id"), F.lit(".html")))
    pages = link_pages(moved)
    starts = moved.select(F.col("url").alias("start"))
    return discovery.discover(pages, starts, limit=None).select("start", "url", *big("position"))


@query
def rank_links(t):
    links = unnest(link_pages(t.pages), ["page_id"], "links", "pos", "link").withColumn(
        "question", F.lit("That other THERE or"))
    return discovery.rank_links(links, ["page_id"]).select("page_id", "link", *big("pos", "score", "rank"))


@query
def top_links(t):
    return discovery.top_links(link_pages(t.pages), "that other there", 5).select(
        "page_id", *big("rank"), "link", *big("score", "target_id"))


@query
def crawl_bfs(t):
    """Every page starts a session on its site, seeded with the site's pages in structural order.

    Pages whose URL has a query are stored already; the pages' own links are ranked by a question.
    """
    pages = link_pages(t.pages)
    urls = t.page_urls().select("page_id", "url", "start")
    order = discovery.structural_order(urls.select("start", "url"), limit=None)
    starts = urls.select(F.col("page_id").alias("session"), F.col("url").alias("start"), F.lit("that other there").alias("question"))
    stored = duplicates.existing_sources(t.pages.filter("url LIKE '%?%'").select(F.col("url").alias("source")))
    seeds = crawl.site_seeds(order, urls.select(F.col("page_id").alias("session"), "start"), existing=stored)
    return crawl.crawl_bfs(pages, starts, existing=stored, discovered=seeds).select(
        "session", "url", *big("level", "visit"), "ingested")


# Conversations

@query
def list_conversations(t):
    convs = conversations.conversations_of(t.conversations)
    return conversations.list_conversations(convs, "conv_id").select("conv_id", "title", "messages")


@query
def list_messages(t):
    return conversations.list_messages(t.conversations, 3).select("turn", "role", "text")


@query
def append_messages(t):
    """New turns for every conversation number and its double; only some exist."""
    convs = t.conversations.select("conv_id").distinct()
    new = t.conversations.select(
        (F.col("conv_id") * 2).alias("conv_id"), (F.col("turn") + 1000).alias("turn"), "role", "text")
    kept, rejected = conversations.append_messages(convs, t.conversations, new)
    return kept.select("conv_id", "turn", F.lit("kept").alias("state")).unionByName(
        rejected.select("conv_id", "turn", F.lit("rejected").alias("state")))


# Evaluation and telemetry

def _judged(t, hits):
    return evaluation.judge(hits, t.vector_questions(), t.vectors().select("chunk_id", "label"))


@query
def precision_recall(t):
    hits = vector_search.knn(t.vector_questions(), t.vectors(), 10)
    return evaluation.precision_recall(_judged(t, hits), 10)


@query
def mrr(t):
    hits = vector_search.knn(t.vector_questions(), t.vectors(), 10).filter(F.col("query_id") != F.col("chunk_id"))
    return evaluation.mrr(_judged(t, hits))


@query
def compare_runs(t):
    near = vector_search.knn(t.vector_questions(), t.vectors(), 10)
    scoped = vector_search.knn(t.vector_questions().withColumn("scope", F.col("label")), t.vectors(), 10)
    return evaluation.compare_runs({"whole": _judged(t, near), "scoped": _judged(t, scoped)}, 10)


@query
def event_rates(t):
    r = telemetry.rates(t.user_events(), ["event_type"])
    return r.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "events", "rate", "value_rate")


@query
def window_percentiles(t):
    p = telemetry.window_percentiles(t.user_events(), ["event_type"], window="1 day")
    return p.withColumn("window_start", F.unix_timestamp("window_start"))


@query
def token_cost(t):
    """Conversations as usage of four models' providers: users' turns go in, other turns come out."""
    tokens = telemetry.token_count(F.col("text"))
    asked = F.col("role") == "user"
    usage = t.conversations.select(
        F.concat(F.lit("p"), F.col("conv_id") % 4).alias("provider_id"), (F.col("conv_id") % 50 + 1).cast("string").alias("model_id"),
        F.when(asked, tokens).otherwise(0).alias("input_tokens"), F.when(asked, 0).otherwise(tokens).alias("output_tokens"))
    prices = t.part.groupBy(F.col("p_size").cast("string").alias("model_id")).agg(
        F.min("p_retailprice").alias("cost_input"), F.max("p_retailprice").alias("cost_output"))
    catalog = usage.select("provider_id", "model_id").distinct().join(prices, "model_id")
    return telemetry.token_cost(usage, catalog)


# Streams

@query
def stream_ingest(t):
    return streams.ingest_result(t.spark, t.sf_dir)


@query
def stream_dedup(t):
    return streams.dedup_result(t.spark, t.sf_dir)


@query
def stream_job_state(t):
    return streams.job_state_result(t.spark, t.sf_dir)


@query
def stream_sessions(t):
    return streams.sessions_result(t.spark, t.sf_dir)


@query
def stream_rates(t):
    return streams.rates_result(t.spark, t.sf_dir)


@query
def stream_percentiles(t):
    return streams.percentiles_result(t.spark, t.sf_dir)


@query
def stream_sliding_percentiles(t):
    return streams.sliding_result(t.spark, t.sf_dir)


@query
def stream_retention(t):
    return streams.retention_result(t.spark, t.sf_dir)
