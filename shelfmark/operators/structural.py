"""Parsed documents to chunks that keep their section."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drop_null_values, is_blank, let, map_merge, stable_id, unnest
from ..functions import splitters
from ..model import BLOCK_TYPE, GROUP_TYPE, ChunkingConfig, Variant
from .chunking import splitter_metadata, with_drafts

PATH_SEPARATOR = " > "
BLOCK_SEPARATOR = "\n\n"
_GROUPS = f"cast(array() as array<{GROUP_TYPE}>)"
_HELD = f"cast(array() as array<{BLOCK_TYPE}>)"
_PATH = "cast(array() as array<string>)"


def _group(text, kind, path, location, metadata, is_protected) -> Column:
    return F.struct(
        text.alias("text"), kind.alias("content_type"), path.alias("section_path"),
        location.alias("location"), metadata.alias("metadata"), F.lit(is_protected).alias("is_protected"),
        F.array_join(path, PATH_SEPARATOR).alias("context"),
    ).cast(GROUP_TYPE)


def _joined(held: Column) -> Column:
    return F.array_join(F.transform(held, lambda b: b["content"]), BLOCK_SEPARATOR)


def _all_of(held: Column, kind: str) -> Column:
    return F.forall(held, lambda b: b["type"] == kind)


def _is_heading(b: Column) -> Column:
    return b["type"].isin("HEADING", "TITLE")


def _shown(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: ~is_blank(b["content"]))


def group_sections(blocks: Column, config: ChunkingConfig, max_chars: int) -> Column:
    """Groups of neighbouring blocks of one section and page.

    Folds over the blocks of one document. The state holds the finished groups, the
    blocks held back, their length, the section set by the last heading and the section
    and page the held blocks began with; a flush leaves the last two as they are.
    """
    zero = F.expr(
        f"named_struct('out', {_GROUPS}, 'held', {_HELD}, 'chars', 0, 'section', {_PATH}, "
        f"'held_section', {_PATH}, 'page', cast(null as int))")

    def state(out, held, chars, section, held_section, page) -> Column:
        return F.struct(out.alias("out"), held.alias("held"), chars.cast("int").alias("chars"),
                        section.alias("section"), held_section.alias("held_section"), page.alias("page"))

    def flush(a: Column) -> Column:
        held = a["held"]
        kind = (F.when(_all_of(held, "LIST"), "LIST").when(_all_of(held, "QUOTE"), "QUOTE")
                .otherwise("PARAGRAPH"))
        first = F.get(held, F.lit(0))
        return F.when(F.size(held) == 0, a).otherwise(state(
            F.array_append(a["out"], _group(_joined(held), kind, a["held_section"], first["location"],
                                            first["metadata"], False)),
            F.expr(_HELD), F.lit(0), a["section"], a["held_section"], a["page"]))

    def add(a: Column, b: Column, section: Column) -> Column:
        empty = F.size(a["held"]) == 0
        grown = state(
            a["out"], F.array_append(a["held"], b),
            a["chars"] + F.when(empty, 0).otherwise(len(BLOCK_SEPARATOR)) + F.length(b["content"]),
            section, F.when(empty, section).otherwise(a["held_section"]),
            F.when(empty, b["location"]["page"]).otherwise(a["page"]))
        return let(grown, lambda g: F.when(g["chars"] > max_chars, flush(g)).otherwise(g))

    def step(a: Column, b: Column) -> Column:
        own = F.size(b["section_path"]) > 0
        heading = let(flush(a), lambda f: state(
            f["out"], f["held"], f["chars"],
            F.when(own, b["section_path"]).otherwise(F.array(b["content"])), f["held_section"], f["page"]))
        section = a["section"] if config.respect_section_boundaries else (
            F.when(own, b["section_path"]).otherwise(a["section"]))
        page = b["location"]["page"]
        moved = (own & (a["held_section"] != b["section_path"])) | (
            (F.size(a["held"]) > 0) & page.isNotNull() & ~page.eqNullSafe(a["page"]))
        alone = F.lit(False)
        if config.preserve_tables:
            alone = alone | (b["type"] == "TABLE")
        if config.preserve_code:
            alone = alone | (b["type"] == "CODE")
        body = let(F.when(moved | alone, flush(a)).otherwise(a), lambda f: F.when(alone, state(
            F.array_append(f["out"], _group(b["content"], b["type"], section, b["location"], b["metadata"], True)),
            f["held"], f["chars"], section, f["held_section"], f["page"])).otherwise(add(f, b, section)))
        return F.when(_is_heading(b), heading).otherwise(body)

    return F.aggregate(_shown(blocks), zero, step, lambda a: flush(a)["out"])


def group_json(blocks: Column, config: ChunkingConfig, max_chars: int) -> Column:
    """Groups of neighbouring records of one path, bounded in number and length."""
    zero = F.expr(f"named_struct('out', {_GROUPS}, 'held', {_HELD}, 'chars', 0)")

    def state(out, held, chars) -> Column:
        return F.struct(out.alias("out"), held.alias("held"), chars.cast("int").alias("chars"))

    def flush(a: Column) -> Column:
        held, first = a["held"], F.get(a["held"], F.lit(0))
        kind = F.when(_all_of(held, "JSON_ARRAY"), "JSON_ARRAY").otherwise("JSON_OBJECT")
        return F.when(F.size(held) == 0, a).otherwise(state(
            F.array_append(a["out"], _group(_joined(held), kind, first["section_path"], first["location"],
                                            first["metadata"], False)),
            F.expr(_HELD), F.lit(0)))

    def step(a: Column, b: Column) -> Column:
        full = (F.size(a["held"]) > 0) & (
            (F.size(a["held"]) >= config.max_records_per_chunk)
            | (F.get(a["held"], F.lit(0))["section_path"] != b["section_path"])
            | (a["chars"] + F.length(b["content"]) > max_chars))
        kept = let(F.when(full, flush(a)).otherwise(a), lambda f: state(
            f["out"], F.array_append(f["held"], b),
            f["chars"] + F.when(F.size(f["held"]) == 0, 0).otherwise(len(BLOCK_SEPARATOR)) + F.length(b["content"])))
        return F.when(_is_heading(b), flush(a)).otherwise(kept)

    return F.aggregate(_shown(blocks), zero, step, lambda a: flush(a)["out"])


def with_groups(parsed: DataFrame, variant: Variant, config: ChunkingConfig | None = None) -> DataFrame:
    """Add ``groups`` by the rule of each document's format."""
    config = config or ChunkingConfig()
    limit = config.effective_max_chars(variant.size)
    blocks = F.col("blocks")
    return parsed.withColumn("groups", F.when(
        F.col("source_type") == "JSON", group_json(blocks, config, limit)
    ).otherwise(group_sections(blocks, config, limit)))


def chunk_structural(parsed: DataFrame, variant: Variant, config: ChunkingConfig | None = None,
                     embedder=None) -> DataFrame:
    """Split every group on its own and prefix its section path to each piece.

    Numbering runs over the whole document and is made inside the document's row. Only
    the semantic strategy, whose model needs groups as rows, numbers by a window over
    one document at a time.
    """
    grouped = with_groups(parsed, variant, config)
    keep_text = lambda g: ~is_blank(g["text"])
    if variant.strategy != "semantic":
        pieces = F.flatten(F.transform(
            F.filter("groups", keep_text),
            lambda g: F.transform(
                splitters.split(g["text"], variant),
                lambda d: F.struct(d.alias("draft"), g.alias("group")))))
        rows = unnest(grouped, ["doc_id", "source_type", "metadata"], pieces, "chunk_index", "_p").select(
            "doc_id", "source_type", "metadata", "chunk_index",
            F.col("_p.draft").alias("draft"), F.col("_p.group").alias("group"))
    else:
        flat = unnest(grouped, ["doc_id", "source_type", "metadata"], F.filter("groups", keep_text), "_gi", "group")
        cut = with_drafts(flat.withColumn("_text", F.col("group.text")), variant, "_text", embedder)
        order = Window.partitionBy("doc_id").orderBy("_gi", "_pi")
        pieces = unnest(cut, ["doc_id", "source_type", "metadata", "group", "_gi"], "_drafts", "_pi", "draft")
        rows = pieces.withColumn(
            "chunk_index", F.row_number().over(order) - 1).drop("_gi", "_pi")
    context, path = F.col("group.context"), F.col("group.section_path")
    content = F.when(is_blank(context), F.col("draft.content")).otherwise(
        F.concat(context, F.lit("\n\n"), F.col("draft.content")))
    place = F.col("group.location")
    merged = reduce(map_merge, [
        F.col("group.metadata"), F.map_filter("metadata", lambda k, _: k != "rawBytes"),
        splitter_metadata(variant, F.col("draft")),
        drop_null_values({
            "format": F.col("source_type"), "contentType": F.col("group.content_type"),
            "sectionPath": F.when(F.size(path) > 0, F.array_join(path, PATH_SEPARATOR)),
            "page": place["page"], "domPath": place["dom_path"], "jsonPath": place["json_path"],
            "startOffset": place["start_offset"], "endOffset": place["end_offset"]}),
    ])
    return rows.select(
        stable_id(F.lit(variant.variant_id), F.col("doc_id").cast("string"),
                  F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id", "chunk_index", content.alias("content"),
        F.lit(variant.strategy).alias("strategy"), F.col("source_type").alias("format"),
        F.col("group.content_type").alias("content_type"), path.alias("section_path"),
        merged.alias("metadata"), F.lit(variant.variant_id).alias("variant"))
