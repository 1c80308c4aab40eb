"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import splitters
from ..functions.embedders import HashingEmbedder
from ..functions.text import drop_null_values, is_blank, map_merge, stable_id, unnest
from ..model import Variant


def splitter_metadata(variant: Variant, draft: Column) -> Column:
    """What a strategy records about each of its chunks."""
    entries: dict[str, Column] = {"strategy": F.lit(variant.strategy)}
    if variant.strategy == "fixed":
        entries |= {"start": draft["start"], "end": draft["end"]}
    elif variant.strategy == "token":
        entries |= {"maxTokens": F.lit(variant.max_tokens), "tokenCount": draft["token_count"]}
    else:
        entries["maxChunkSize"] = F.lit(variant.size)
    return drop_null_values(entries)


def chunk(docs: DataFrame, variant: Variant, *, doc_id: str = "doc_id", text: str = "text",
          keep: Sequence[str] = (), metadata: str | None = None, embedder=None) -> DataFrame:
    """Split each document; one output row per chunk, numbered from 0.

    ``keep`` names document columns to carry along. With ``metadata`` (a string map
    column) the result has a ``metadata`` map of document and splitter entries. The
    whole operator is narrow: scan, split inside the row, explode.
    """
    cols = [doc_id, *keep, *([metadata] if metadata else [])]
    drafts_df = with_drafts(docs.filter(~is_blank(F.col(text))).select(*cols, text),
                            variant, text, embedder)
    rows = unnest(
        drafts_df,
        [F.col(doc_id).alias("doc_id"), *keep, *([F.col(metadata).alias("_meta")] if metadata else [])],
        "_drafts", "chunk_index", "_draft",
    )
    return rows.select(
        stable_id(F.lit(variant.variant_id), F.col("doc_id").cast("string"),
                  F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id", "chunk_index",
        F.col("_draft.content").alias("content"),
        F.lit(variant.strategy).alias("strategy"),
        F.col("_draft.start").alias("start_pos"),
        F.col("_draft.end").alias("end_pos"),
        F.col("_draft.token_count").alias("token_count"),
        F.lit(variant.variant_id).alias("variant"),
        *keep,
        *([map_merge(F.coalesce(F.col("_meta"), F.expr("cast(map() as map<string,string>)")),
                     splitter_metadata(variant, F.col("_draft"))).alias("metadata")]
          if metadata else []),
    )


def with_drafts(df: DataFrame, variant: Variant, text: str, embedder=None,
                out: str = "_drafts") -> DataFrame:
    """Add the drafts of ``text`` as an array column; a narrow step for every strategy.

    For the semantic strategy only the sentences of texts over the window visit the
    model, and only their distances come back.
    """
    if variant.strategy != "semantic":
        return df.withColumn(out, splitters.split(F.col(text), variant))
    model = embedder or HashingEmbedder(variant.embedding_dimension)
    wanted = F.when(F.length(text) > variant.size, splitters.sentences(F.col(text))).otherwise(
        F.expr("cast(array() as array<string>)")
    )
    return (
        df.withColumn("_sents", wanted)
        .withColumn("_dist", model.neighbour_distances(F.col("_sents")))
        .withColumn(out, splitters.group_semantic(
            F.col(text), F.col("_sents"), F.col("_dist"),
            variant.size, variant.overlap, variant.percentile))
        .drop("_sents", "_dist")
    )


def chunk_fixed(docs: DataFrame, size: int, overlap: int, **kw) -> DataFrame:
    return chunk(docs, Variant(f"fixed_{size}_{overlap}", "fixed", size, overlap), **kw)


def chunk_token(docs: DataFrame, max_tokens: int, overlap: int, **kw) -> DataFrame:
    return chunk(docs, Variant(f"token_{max_tokens}_{overlap}", "token", max_tokens * 4, overlap * 4), **kw)


def chunk_recursive(docs: DataFrame, size: int, overlap: int, **kw) -> DataFrame:
    return chunk(docs, Variant(f"recursive_{size}_{overlap}", "recursive", size, overlap), **kw)


def chunk_semantic(docs: DataFrame, size: int, overlap: int, percentile: float = 95.0,
                   embedder=None, **kw) -> DataFrame:
    variant = Variant(f"semantic_{size}_{overlap}", "semantic", size, overlap, percentile=percentile)
    return chunk(docs, variant, embedder=embedder, **kw)


def chunk_variants(docs: DataFrame, variants: Iterable[Variant], **kw) -> DataFrame:
    """One corpus under several variants, as a union of narrow branches."""
    branches = [
        chunk(docs, v, **kw).withColumn("module", F.lit(v.module)) for v in variants
    ]
    if not branches:
        raise ValueError("at least one variant is required")
    return reduce(DataFrame.unionByName, branches)


def sentence_count(docs: DataFrame, size: int, text: str = "text") -> Column:
    """Sentences a semantic split would embed: none when the text fits or has only one."""
    n = F.size(splitters.sentences(F.col(text)))
    return F.when(F.length(text) <= size, F.lit(0)).when(n > 1, n).otherwise(F.lit(0))


def compare_chunking(docs: DataFrame, variants: Sequence[Variant], *, baseline: str,
                     text: str = "text", embedder=None) -> DataFrame:
    """Cost of each variant: chunks, chunks per document and embedding calls.

    Split-time calls are the sentences a semantic variant embeds before it cuts. The
    counting happens inside each document's row, so only one partial aggregate per
    task and variant is shuffled.
    """
    rows = docs.filter(~is_blank(F.col(text))).select(text)
    for i, v in enumerate(variants):
        calls = sentence_count(rows, v.size, text) if v.strategy == "semantic" else F.lit(0)
        rows = with_drafts(rows, v, text, embedder).select(
            *rows.columns, F.size("_drafts").alias(f"_chunks{i}"), calls.alias(f"_calls{i}"))
    # One scan and one aggregate for all variants; its single row is then turned into theirs.
    totals = rows.agg(F.count(F.lit(1)).alias("documents"), *[
        F.sum(f"_{c}{i}").alias(f"_{c}{i}") for i in range(len(variants)) for c in ("chunks", "calls")])
    table = totals.select("documents", F.explode(F.array(*[F.struct(
        F.lit(v.variant_id).alias("variant"), F.col(f"_chunks{i}").alias("chunks"), F.col(f"_calls{i}").alias("split_embeds"),
    ) for i, v in enumerate(variants)])).alias("_v")).select("documents", "_v.*").withColumn(
        "ingest_embeds", F.col("chunks") + F.col("split_embeds")
    )
    # One row per variant from here on: the single window holds len(variants) rows.
    whole = Window.partitionBy(F.lit(0))
    base = F.max(F.when(F.col("variant") == baseline, F.col("ingest_embeds"))).over(whole)
    return table.select(
        "variant", "documents", "chunks",
        F.round(F.col("chunks") / F.col("documents"), 6).alias("chunks_per_document"),
        "split_embeds", "ingest_embeds",
        F.round(F.col("ingest_embeds") / base, 6).alias("ratio_to_baseline"),
    )


def embed_chunks(chunks: DataFrame, embedder=None, *, content: str = "content") -> DataFrame:
    """Add the ``embedding`` column."""
    return chunks.withColumn("embedding", (embedder or HashingEmbedder()).embed(F.col(content)))
