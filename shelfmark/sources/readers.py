"""Sources: folders, request rows, fetched pages, catalogs, sitemap and robots bodies."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import is_blank, jtrim, map_merge, stable_id, unnest
from ..operators.parsing import BLOCKS, _batched, _block, web_page
from ..model import BLOCK_TYPES

UNTITLED = "Untitled document"
WHOLE_BYTES = 1 << 26      # files up to this size are hashed as one value
LINE_BYTES = 1 << 26       # of larger ones, the longest line that is read
SEPARATORS = ("\n", " ", ",", "\0", "0", "A", "a")
MARK = b"\xef\xbb\xbf"
EMPTY_MAP = "cast(map() as map<string,string>)"


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` as documents with their bytes, and the number of these.

    Names starting with a dot are left out. Spark's own listing also passes over names
    starting with an underscore and hidden folders, which differs from a plain walk.

    Files over ``WHOLE_BYTES`` are hashed line by line when this is called. ``raw`` is one value,
    which Spark confines to 2 GB; a larger file fails the job, but only if ``raw`` is asked for.
    """
    def listed(paths: str | list[str]) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        return found.select("*", F.col("_metadata.file_path").alias("_file"))

    base = root.rstrip("/") + "/"
    # The listing gives full URIs; everything up to the root folder is dropped.
    at = F.instr(F.col("path"), base)
    source = F.when(at > 0, F.expr(f"substring(path, instr(path, {_sql(base)}) + {len(base)})")).otherwise(F.col("path"))
    name = F.substring_index("path", "/", -1)
    files, digest = listed(root).filter(~name.startswith(".")), F.sha2("content", 256)
    # Filters on the length reach the reader, and no bytes are read for columns that are not asked for.
    hashed, large = files.filter(F.col("length") <= WHOLE_BYTES).withColumn("_hash", digest), files.filter(F.col("length") > WHOLE_BYTES)
    sized = large.select("path", "_file", "length").collect()
    known = _streamed_hashes(spark, sized)
    if known:
        hashed = hashed.unionByName(large.join(F.broadcast(spark.createDataFrame(list(known.items()), "_file string, _hash string")), "_file"))
    whole = [_literal(r["path"]) for r in sized if r["_file"] not in known]
    if whole:
        hashed = hashed.unionByName(listed(whole).withColumn("_hash", digest))
    return hashed.select(
        stable_id(source).alias("doc_id"), F.lit("").alias("text"), F.col("content").alias("raw"),
        F.create_map(
            F.lit("sourceType"), F.lit("file"), F.lit("source"), source, F.lit("fileName"), name,
            F.lit("title"), name, F.lit("contentHash"), F.col("_hash"),
        ).alias("metadata"),
        F.col("modificationTime").alias("created_at"), F.col("length").alias("bytes"),
    )


def _streamed_hashes(spark: SparkSession, files: list[Row]) -> dict[str, str]:
    """The SHA-256 of large files, each of whose lines one task takes in one after the other.

    Spark gives a text's lines as the bytes they are, without what separates them. A file with a line over
    ``LINE_BYTES`` is read anew by the next of ``SEPARATORS``; one that has long lines by each of them is left out.
    """
    known: dict[str, str] = {}
    for separator in SEPARATORS:
        todo = [r for r in files if r["_file"] not in known]
        if todo:
            known |= {r["_file"]: r["_hash"] for r in _hashed_lines(spark, todo, separator).filter("_hash IS NOT NULL").collect()}
    return known


def _hashed_lines(spark: SparkSession, files: list[Row], separator: str) -> DataFrame:
    """``_file, _hash`` of files read as lines; the hash is null where lines were too long to be read.

    The line reader would unpack files whose names end like those of packed ones, so every ending is declared to
    need no unpacking; such files are not split either. The reader also leaves out a byte order mark at the start and does
    not tell whether there was a last separator; the size of the file tells both.
    """
    sizes, between = {r["_file"]: r["length"] for r in files}, separator.encode()
    # Files without an ending, or one that the setting would trim, may be split, so each of them has a group of its own.
    groups: dict[str, list[str]] = {}
    for r in files:
        dot = r["path"].rfind(".", r["path"].rfind("/") + 1)
        groups.setdefault(r["path"][dot:] if dot >= 0 and r["path"] == r["path"].strip() else r["path"], []).append(_literal(r["path"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            state, rest = (marked, sizes[file] - read - len(MARK)) if sizes[file] - read >= len(MARK) else (plain, sizes[file] - read)
            state.update(between if rest == len(between) else b"")
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([state.hexdigest() if rest in (0, len(between)) else None], pa.string())], ["_file", "_hash"])

        file = None
        for batch in batches:
            runs = pc.run_end_encode(batch.column("file"))
            begin = 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if name != file:
                    if file is not None:
                        yield result()
                    file, plain, marked, read, at = name, hashlib.sha256(), hashlib.sha256(MARK), None, 0
                starts, lines = batch.column("start").to_numpy()[begin:end], batch.column("line").slice(begin, end - begin)
                if starts[0] < at or (np.diff(starts) < 0).any():
                    raise ValueError(f"{file}: its parts were not read in order")
                part = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), between)[0].as_buffer()
                for state in (plain, marked):
                    state.update(between if read is not None else b"")
                    state.update(part)
                at, begin, read = starts[-1], end, part.size + (0 if read is None else read + len(between))
        if file is not None:
            yield result()

    # The names of these settings differ between builds of Hadoop.
    hadoop, found = spark._jvm.org.apache.hadoop, None
    codec, longest = hadoop.io.compress.PassthroughCodec, hadoop.mapreduce.lib.input.LineRecordReader.MAX_LINE_LENGTH
    for ending, paths in groups.items():
        packed = ending.startswith(".")
        as_is = {"io.compression.codecs": codec.CLASSNAME, codec.OPT_EXTENSION: ending} if packed else {}
        lines = spark.read.options(**as_is).option(longest, LINE_BYTES).option("lineSep", separator).text(paths).select(
            F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        # One hash is one chain over all bytes; parts of a file are put into one task in their order.
        part = (lines if packed else lines.coalesce(1)).mapInArrow(run, "_file string, _hash string")
        found = part if found is None else found.unionByName(part)
    return found


def _literal(path: str) -> str:
    """A path that Spark does not take for a pattern."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def read_documents(requests: DataFrame, *, text: str = "text", metadata: str = "metadata",
                   raw: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted documents and rejected requests.

    A request needs text or bytes. The title defaults to the file name, or to a fixed text.
    """
    has_raw = F.coalesce(F.length(raw) > 0, F.lit(False)) if raw else F.lit(False)
    ok = ~is_blank(F.col(text)) | has_raw
    given = F.coalesce(F.col(metadata), F.expr(EMPTY_MAP))
    title = F.coalesce(F.element_at(given, "title"), F.element_at(given, "fileName"), F.lit(UNTITLED))
    filled = map_merge(given, F.create_map(F.lit("title"), title))
    accepted = requests.filter(ok).withColumn(metadata, filled)
    rejected = requests.filter(~ok).withColumn("reject_reason", F.lit("content is blank and no bytes were sent"))
    return accepted, rejected


def read_pages(pages: DataFrame) -> DataFrame:
    """Fetched bodies to ``page_id, url, title, text, links, nav_links, blocks``."""
    return pages.withColumn("_page", web_page(F.col("html"), F.col("url"))).select(
        "page_id", "url", "_page.title", "_page.text", "_page.links", "_page.nav_links", "_page.blocks")


def page_to_document(pages: DataFrame) -> DataFrame:
    """Pages to parsed documents; a page without blocks becomes one paragraph of its text."""
    def known(b):
        kind = F.upper(jtrim(F.coalesce(b["type"], F.lit(""))))
        return F.when(kind.isin(*BLOCK_TYPES), kind).otherwise("PARAGRAPH")

    blocks = F.when(
        F.coalesce(F.size("blocks"), F.lit(0)) <= 0,
        F.array(_block(F.lit("PARAGRAPH"), F.coalesce("text", F.lit("")))),
    ).otherwise(F.transform("blocks", lambda b: b.withField("type", known(b)).withField(
        "section_path", F.coalesce(b["section_path"], F.expr("cast(array() as array<string>)"))))).cast(BLOCKS)
    fixed = F.create_map(F.lit("sourceType"), F.lit("web"), F.lit("source"), F.col("url"),
                         F.lit("format"), F.lit("HTML"))
    titled = F.when(is_blank(F.col("title")), F.expr(EMPTY_MAP)).otherwise(
        F.create_map(F.lit("title"), F.col("title")))
    return pages.select(
        F.col("page_id").alias("doc_id"), F.lit("HTML").alias("source_type"),
        F.map_concat(fixed, titled).alias("metadata"), blocks.alias("blocks"))


CATALOG_TYPE = (
    "map<string,struct<api:string,env:array<string>,models:map<string,struct<"
    "name:string,limit:struct<context:bigint,output:bigint>,reasoning:boolean,tool_call:boolean,"
    "structured_output:boolean,cost:struct<input:double,output:double>,status:string>>>>"
)


def flatten_catalog(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per provider and model of a nested catalog, with defaults filled in."""
    providers = bodies.select(F.explode(F.map_entries(F.from_json(F.col(body), CATALOG_TYPE))).alias("p"))
    models = providers.select(
        F.col("p.key").alias("provider_id"), F.col("p.value.api").alias("base_url"),
        F.get("p.value.env", F.lit(0)).alias("api_key_env"),
        F.explode(F.map_entries("p.value.models")).alias("m"))
    m = "m.value"
    number = lambda c, zero: F.coalesce(F.col(f"{m}.{c}"), F.lit(zero))
    return models.select(
        "provider_id", F.col("m.key").alias("model_id"),
        F.coalesce(F.col(f"{m}.name"), F.col("m.key")).alias("name"),
        number("limit.context", 0).cast("bigint").alias("context_limit"),
        number("limit.output", 0).cast("bigint").alias("output_limit"),
        number("reasoning", False).alias("reasoning"), number("tool_call", False).alias("tool_call"),
        number("structured_output", False).alias("structured_output"),
        number("cost.input", 0.0).alias("cost_input"), number("cost.output", 0.0).alias("cost_output"),
        F.col(f"{m}.status").alias("status"), "base_url", "api_key_env")


def read_sitemaps(bodies: DataFrame) -> DataFrame:
    """``url, is_index, pos, loc`` from sitemap bodies; unsound XML gives no row."""
    parsed = _batched("struct<is_index:boolean,locs:array<string>>", markup.sitemap)(F.col("body"))
    return unnest(
        bodies.select("url", parsed.alias("s")), ["url", F.col("s.is_index").alias("is_index")], "s.locs", "pos", "loc")


def robots_rules(body: Column) -> Column:
    """Directives of one robots body, folded line by line: ``struct<kind, value>``."""
    zero = F.expr("named_struct('wild', false, 'out', cast(array() as array<struct<kind:string,value:string>>))")

    def step(acc, line):
        clean = jtrim(F.substring_index(line, "#", 1))
        colon = F.instr(clean, ":")
        key = F.lower(jtrim(F.substring(clean, F.lit(1), colon - 1)))
        value = jtrim(F.substring(clean, colon + 1, F.length(clean)))
        add = F.struct(acc["wild"].alias("wild"), F.array_append(
            acc["out"], F.struct(key.alias("kind"), value.alias("value"))).alias("out"))
        return (
            F.when(colon == 0, acc)
            .when(key == "user-agent", F.struct((value == "*").alias("wild"), acc["out"].alias("out")))
            .when((key == "sitemap") | ((key == "disallow") & acc["wild"]), add)
            .otherwise(acc)
        )

    return F.aggregate(F.split(F.coalesce(body, F.lit("")), r"\R"), zero, step, lambda a: a["out"])


def read_robots(bodies: DataFrame) -> DataFrame:
    """``host, kind, pos, value`` where kind is ``sitemap`` or ``disallow``.

    The agent a rule belongs to depends on the lines before it, so each body is folded
    inside its row.
    """
    return unnest(bodies, ["host"], robots_rules(F.col("body")), "pos", "_r").select(
        "host", F.col("_r.kind").alias("kind"), "pos", F.col("_r.value").alias("value"))
