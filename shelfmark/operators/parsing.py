"""Documents to parsed documents: one row with an ordered array of typed blocks.

A parsed document is ``doc_id, source_type, metadata, blocks`` (plus the columns the
caller keeps). Blocks stay inside their document's row, so section paths and grouping
never need a shuffle; :func:`explode_blocks` gives the flat table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import is_blank, jtrim, let, map_merge, unnest
from ..model import BLOCK_TYPE, SOURCE_TYPES

# The formats told by a file extension or a content type.
EXTENSIONS = {
    "pdf": "PDF", "docx": "DOCX", "html": "HTML", "htm": "HTML", "md": "MARKDOWN",
    "markdown": "MARKDOWN", "json": "JSON", "txt": "TEXT", "text": "TEXT",
}
CONTENT_TYPES = {
    "application/pdf": "PDF",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX",
    "text/html": "HTML", "application/xhtml+xml": "HTML", "text/markdown": "MARKDOWN",
    "application/json": "JSON", "text/plain": "TEXT",
}
TEXTUAL = ("TEXT", "HTML", "MARKDOWN", "JSON")
BLOCKS = f"array<{BLOCK_TYPE}>"
STEP = 64  # rows that a reader holds as Python objects at a time
NO_BLOCKS = f"cast(array() as {BLOCKS})"


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.element_at(pairs, F.coalesce(key, F.lit("")))


def _present(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def format_of(metadata: Column, raw: Column | None = None) -> Column:
    """Explicit format, then extension, then content type, then magic bytes."""
    entry = lambda key: _present(F.element_at(metadata, F.lit(key)))
    named = F.upper(jtrim(entry("format")))
    explicit = F.when(named.isin(*SOURCE_TYPES), named)
    source = entry("source")
    # A source that is no valid URI is taken as a path.
    url_path = F.coalesce(
        F.when(F.try_parse_url(source, F.lit("PATH")).isNotNull(),
               F.try_parse_url(source, F.lit("PATH"))), source)
    path = F.coalesce(entry("fileName"), url_path)
    clean = F.substring_index(F.substring_index(path, "?", 1), "#", 1)
    extension = _lookup(EXTENSIONS, F.lower(F.regexp_extract(clean, r"\.([^.]+)$", 1)))
    content_type = _lookup(
        CONTENT_TYPES, F.lower(jtrim(F.substring_index(entry("contentType"), ";", 1))))
    found = F.coalesce(explicit, extension, content_type)
    if raw is not None:
        magic = lambda text: F.substring(raw, 1, len(text)) == F.lit(text.encode())
        found = F.coalesce(found, F.when(magic("%PDF"), "PDF").when(magic("PK"), "DOCX"))
    return F.coalesce(found, F.lit("UNKNOWN"))


def detect_format(docs: DataFrame, metadata: str = "metadata", raw: str | None = None) -> DataFrame:
    return docs.withColumn("format", format_of(F.col(metadata), F.col(raw) if raw else None))


def plain_blocks(content: Column) -> Column:
    return F.array(_block(F.lit("PARAGRAPH"), content))


def _block(kind: Column, content: Column, section: Column | None = None, json_path: Column | None = None,
           metadata: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        kind.alias("type"), content.alias("content"),
        (section if section is not None else F.expr("cast(array() as array<string>)")).alias("section_path"),
        F.struct(
            none.cast("int").alias("page"), none.cast("string").alias("dom_path"),
            (json_path if json_path is not None else none.cast("string")).alias("json_path"),
            none.cast("int").alias("start_offset"), none.cast("int").alias("end_offset"),
        ).alias("location"),
        (metadata if metadata is not None else F.expr("cast(map() as map<string,string>)")).alias("metadata"),
    ).cast(BLOCK_TYPE)


def json_blocks(content: Column) -> Column:
    """Blocks of a JSON text, one level deep; null when it is not a JSON value.

    Nested values keep their text and key order but are written compactly.
    """
    items, item_kinds = F.from_json(content, "array<string>"), F.from_json(content, "array<variant>")
    fields, field_kinds = F.from_json(content, "map<string,string>"), F.from_json(content, "map<string,variant>")
    array_blocks = let(
        F.struct(items.alias("text"), item_kinds.alias("kind")),
        lambda a: _element_blocks(a["text"], a["kind"], F.lit("$"), F.expr("cast(array() as array<string>)")),
    )
    object_blocks = let(
        F.struct(F.map_entries(fields).alias("text"), F.map_values(field_kinds).alias("kind")), _object_blocks)
    first = F.substring(jtrim(content), 1, 1)
    scalar = F.try_parse_json(content)
    return (
        F.when(is_blank(content), F.lit(None).cast(BLOCKS))
        .when(first == "[", F.when(items.isNotNull(), array_blocks))
        .when(first == "{", F.when(fields.isNotNull(), object_blocks))
        .when(scalar.isNotNull() & (F.schema_of_variant(scalar) != "VOID"), F.array(
            _block(F.lit("JSON_OBJECT"), F.to_json(scalar), json_path=F.lit("$"))))
    )


def _is(kind: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(kind), F.lit("VOID")).startswith(name)


def _element_blocks(texts: Column, kinds: Column, path: Column, section: Column) -> Column:
    return F.transform(
        texts,
        lambda t, i: _block(
            F.when(_is(F.get(kinds, i), "ARRAY"), "JSON_ARRAY").otherwise("JSON_OBJECT"),
            F.coalesce(t, F.lit("null")), section,
            F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))),
    )


def _object_blocks(o: Column) -> Column:
    """Runs of scalar fields become one block, each container field its own blocks."""
    zero = F.expr(f"named_struct('out', {NO_BLOCKS}, 'run', cast(array() as array<string>))")

    def flushed(acc: Column) -> Column:
        return F.when(F.size(acc["run"]) == 0, acc["out"]).otherwise(F.array_append(
            acc["out"],
            _block(F.lit("JSON_OBJECT"), F.concat(F.lit("{"), F.array_join(acc["run"], ","), F.lit("}")),
                   json_path=F.lit("$"))))

    def step(acc: Column, f: Column) -> Column:
        path = F.concat(F.lit("$."), f["key"])
        elements = let(
            F.struct(F.from_json(f["text"], "array<string>").alias("t"),
                     F.from_json(f["text"], "array<variant>").alias("k")),
            lambda a: _element_blocks(a["t"], a["k"], path, F.array(f["key"])))
        nested = F.array(_block(F.lit("JSON_OBJECT"), f["text"], F.array(f["key"]), path))
        empty = F.expr("cast(array() as array<string>)")
        pair = F.concat(F.to_json(F.struct(f["key"].alias("k"))), F.lit(""))
        # '{"k":"name"}' holds the escaped name between the fifth character and the brace.
        label = F.substring(pair, 6, F.length(pair) - 6)
        return (
            F.when(_is(f["kind"], "ARRAY"), F.struct(F.concat(flushed(acc), elements).alias("out"), empty.alias("run")))
            .when(_is(f["kind"], "OBJECT"), F.struct(F.concat(flushed(acc), nested).alias("out"), empty.alias("run")))
            .otherwise(F.struct(acc["out"].alias("out"), F.array_append(
                acc["run"],
                F.concat(label, F.lit(":"), F.coalesce(F.to_json(f["kind"]), F.lit("null")))).alias("run")))
        )

    entries = F.transform(
        o["text"],
        lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("text"), F.get(o["kind"], i).alias("kind")))
    return F.aggregate(entries, zero, step, flushed)


def _arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


def _batched(returns: str, read, columns: int = 1):
    """An Arrow UDF applying ``read`` to every value of its column or columns.

    Results go out every few rows, so a worker never holds a whole batch of them.
    """
    arrow_type = _arrow_type(returns)

    def results(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch[0]), STEP):
                rows = zip(*[c.slice(at, STEP).to_pylist() for c in batch])
                yield pa.array([None if row[0] is None else _as_arrow(read(*[x or "" for x in row])) for row in rows], type=arrow_type)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from results((b,) for b in batches)

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from results(batches)

    # A reader is worth running once: marked so, it is not copied below filters that use
    # its result.
    return F.arrow_udf(one if columns == 1 else many, returns).asNondeterministic()


def _as_arrow(value):
    """Maps travel to Arrow as lists of pairs."""
    if isinstance(value, dict):
        return {k: list(v.items()) if k == "metadata" else _as_arrow(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_as_arrow(v) for v in value]
    return value


PAGE_TYPE = (
    f"struct<title:string,text:string,links:array<string>,nav_links:array<string>,blocks:{BLOCKS}>"
)
_MARKDOWN = "array<struct<type:string,level:int,content:string,language:string>>"


def html_blocks(content: Column, heuristic_headings: bool = False) -> Column:
    return _batched(BLOCKS, lambda html: markup.html_document(html, heuristic_headings))(content)


def web_page(html: Column, url: Column) -> Column:
    return _batched(PAGE_TYPE, markup.web_page, 2)(html, url)


def _marked_up(kind: str, text: str) -> dict:
    html = kind == "HTML"
    return {"html": markup.html_document(text) if html else None, "md": None if html else markup.markdown(text)}


def with_sections(marked: Column) -> Column:
    """Blocks from ``struct<type, level, content, language>`` items.

    A heading cuts the path back to its level; every block carries the path it stands in.
    """
    zero = F.expr(f"named_struct('out', {NO_BLOCKS}, 'path', cast(array() as array<string>))")

    def step(acc: Column, b: Column) -> Column:
        path = F.when(b["type"] == "HEADING", F.array_append(
            F.slice(acc["path"], 1, b["level"] - 1), b["content"])).otherwise(acc["path"])
        meta = F.when(b["language"].isNotNull(), F.create_map(F.lit("codeLanguage"), b["language"])).otherwise(
            F.expr("cast(map() as map<string,string>)"))
        return let(path, lambda p: F.struct(
            F.array_append(acc["out"], _block(b["type"], b["content"], p, metadata=meta)).alias("out"),
            p.alias("path")))

    return F.aggregate(marked, zero, step, lambda acc: acc["out"])


def markdown_blocks(content: Column) -> Column:
    return with_sections(_batched(_MARKDOWN, markup.markdown)(content))


def heading_like(text: Column) -> Column:
    """Short line without closing punctuation: at most 80 characters and 12 words."""
    return (
        (text != "") & (F.length(text) <= 80)
        & (F.size(F.split(text, r"\s+")) <= 12) & ~text.rlike(r"[.,;:?!]$")
    )


def heading_blocks(lines: Column) -> Column:
    """Blocks of text lines where heading-like lines open a section."""
    marked = F.transform(
        F.filter(F.transform(lines, jtrim), lambda t: t != ""),
        lambda t: F.struct(
            F.when(heading_like(t), "HEADING").otherwise("PARAGRAPH").alias("type"),
            F.lit(1).alias("level"), t.alias("content"), F.lit(None).cast("string").alias("language")))
    return with_sections(marked)


def text_of(blocks: Column) -> Column:
    return F.array_join(
        F.transform(F.filter(blocks, lambda b: ~is_blank(b["content"])), lambda b: b["content"]), "\n\n")


def with_text_content(docs: DataFrame, text: str = "text", raw: str | None = "raw") -> DataFrame:
    """Decode the bytes of textual documents that came without text."""
    if raw is None or raw not in docs.columns:
        return docs
    usable = F.col("format").isin(*TEXTUAL) & is_blank(F.col(text)) & (F.length(raw) > 0)
    return docs.withColumn(text, F.when(usable, F.decode(raw, "UTF-8")).otherwise(F.col(text)))


def parse(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", metadata: str = "metadata",
          raw: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Blocks of every document by its detected format.

    Binary formats have no reader here, and unknown ones are taken as plain text. A
    document that its reader rejects has null ``blocks`` and a ``reject_reason``. The
    input is read once: every reader sees its own documents and nulls for the others.
    """
    base = with_text_content(detect_format(docs, metadata, raw), text, raw)
    content = F.coalesce(F.col(text), F.lit(""))
    source_type = F.when(F.col("format").isin("JSON", "MARKDOWN", "HTML"), F.col("format")).otherwise("TEXT")
    marked_up = lambda c: F.when(F.col("format").isin("HTML", "MARKDOWN"), c)
    read = base.select(
        F.col(doc_id).alias("doc_id"), source_type.alias("source_type"), content.alias("_text"),
        map_merge(F.coalesce(F.col(metadata), F.expr("cast(map() as map<string,string>)")),
                  F.create_map(F.lit("format"), source_type)).alias("metadata"), *keep,
        # One reader for both formats, so that a task has one worker for them.
        _batched(f"struct<html:{BLOCKS},md:{_MARKDOWN}>", _marked_up, 2)(
            marked_up(F.col("format")), marked_up(content)).alias("_read"))
    kind = F.col("source_type")
    blocks = (
        F.when(kind == "JSON", json_blocks(F.col("_text")))
        .when(kind == "HTML", F.col("_read.html"))
        .when(kind == "MARKDOWN", with_sections(F.col("_read.md")))
        .otherwise(plain_blocks(F.col("_text")))
    )
    return read.select("doc_id", "source_type", "metadata", blocks.alias("blocks"), *keep).withColumn(
        "reject_reason",
        F.when(F.col("blocks").isNull(), F.concat(
            F.lit("Failed to parse "), F.col("source_type"), F.lit(" document "), F.col("doc_id").cast("string"))))


def reject_empty(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed documents that hold text, and the rest with the reason."""
    blank = F.coalesce(is_blank(text_of(F.col("blocks"))), F.lit(True))
    reason = F.concat(F.lit("No text could be extracted from document "), F.col("doc_id").cast("string"))
    if "reject_reason" in parsed.columns:
        reason = F.coalesce("reject_reason", reason)
    flagged = parsed.withColumn("reject_reason", F.when(blank, reason))
    return (
        flagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        flagged.filter(F.col("reject_reason").isNotNull()).select("doc_id", "reject_reason"),
    )


def explode_blocks(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return unnest(parsed, ["doc_id", *keep], "blocks", "block_idx", "_b").select(
        "doc_id", *keep, "block_idx", "_b.*")
