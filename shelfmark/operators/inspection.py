"""Looking into a chunk store: counts, listings, previews.

All aggregates combine before the shuffle, so a document or store that holds a large
part of the rows still sends one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .telemetry import exact_percentiles


def _known(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("doc_id").isNotNull())


def list_documents(chunks: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Chunk count per document and the given columns of its lowest-numbered chunk."""
    columns = columns or (["metadata"] if "metadata" in chunks.columns else ["chunk_id"])
    first = F.min_by(F.struct(*columns), F.col("chunk_index").cast("bigint"))
    return (
        _known(chunks).groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("chunk_count"), first.alias("_first"))
        .select("doc_id", "chunk_count", *[F.col(f"_first.{c}").alias(c) for c in columns])
    )


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return (
        _known(chunks).groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("chunk_count"), F.min("chunk_id").alias("first_chunk_id"),
             F.max("chunk_id").alias("last_chunk_id"))
        .orderBy(F.col("chunk_count").desc(), "doc_id")
    )


def document_titles(chunks: DataFrame) -> DataFrame:
    """Title and source from the first chunk, fullest document first; orphans form a group."""
    first = F.min_by(F.struct("title", "source"), F.col("chunk_index").cast("bigint"))
    return (
        chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), first.alias("_f"))
        .select("doc_id", "chunk_count", F.col("_f.title").alias("title"), F.col("_f.source").alias("source"))
        .orderBy(F.col("chunk_count").desc(), "doc_id")
    )


def metadata_keys(chunks: DataFrame, column: str = "metadata") -> DataFrame:
    return chunks.select(F.explode(F.map_keys(column)).alias("metadata_key")).distinct()


def orphan_chunks(chunks: DataFrame) -> DataFrame:
    """How many chunks have no document, by kind of absence."""
    doc = F.col("doc_id").cast("string")
    return (
        chunks.select(doc.alias("doc_id")).filter(F.coalesce("doc_id", F.lit("")) == "")
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("orphans"))
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
        for name, df in tables.items()
    ])


def vector_dims(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.size("embedding").alias("dimensions")).agg(
        F.count(F.lit(1)).alias("total_chunks"))


def count_by_document_having(chunks: DataFrame, excluded) -> DataFrame:
    """Chunk counts of all documents but one; a missing id is a group of its own.

    The test sees only the grouping key, so it is applied before the shuffle.
    """
    return (
        chunks.filter(~F.col("doc_id").eqNullSafe(F.lit(excluded)))
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    )


def percentile_nearest_rank(df: DataFrame, keys: list[str], value: str, percentiles: Mapping[str, float]) -> DataFrame:
    """Nearest-rank percentiles per group, named by ``percentiles`` (name -> 0..100)."""
    return exact_percentiles(df, keys, value, percentiles).drop("n")


def batch_summary(jobs: DataFrame, label: str = "batch") -> DataFrame:
    """Outcome per batch once none of its jobs is pending or running.

    ``jobs`` holds the latest state of each job. A batch with neither a completed nor a
    failed job reports nothing. Failures are a table of their own, see
    :func:`batch_failures`, because a batch may have any number of them.
    """
    state = F.col("state")
    return (
        jobs.groupBy(label).agg(
            F.count_if(state == "COMPLETED").alias("completed"),
            F.count_if(state == "FAILED").alias("failed"),
            F.sum(F.when(state == "COMPLETED", F.coalesce("chunk_count", F.lit(0))).otherwise(0)).alias("chunks"),
            F.count_if(state.isin("PENDING", "RUNNING")).alias("_open"),
        )
        .filter((F.col("_open") == 0) & (F.col("completed") + F.col("failed") > 0))
        .drop("_open")
        .withColumn("summary", F.format_string(
            "%s: %d page(s) complete, %d failed, %d chunk(s) total.",
            F.col(label).cast("string"), F.col("completed"), F.col("failed"), F.col("chunks")))
    )


def batch_failures(jobs: DataFrame, label: str = "batch") -> DataFrame:
    return jobs.filter(F.col("state") == "FAILED").select(
        label, F.concat(F.lit(" - "), F.col("doc_id").cast("string"), F.lit(": "),
                        F.coalesce("message", F.lit("null"))).alias("failure"))


def documents_by_store(stores: Mapping[str, DataFrame]) -> DataFrame:
    """Documents of all stores, tagged by store, with counts padded to equal width."""
    listed = reduce(DataFrame.unionByName, [
        _known(df).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
        .select(F.lit(name).alias("module"), "doc_id", "chunk_count")
        for name, df in stores.items()
    ])
    # One number per store, aggregated apart: a window per store would gather it in one task.
    # The counts are written out so that the stores are not counted twice.
    listed = materialize(listed, "listed")
    widths = listed.groupBy("module").agg(
        F.max(F.length(F.col("chunk_count").cast("string"))).alias("_width"))
    return listed.join(F.broadcast(widths), "module").select(
        "module", "doc_id", "chunk_count",
        F.concat(F.lit("("), F.lpad(F.col("chunk_count").cast("string"), F.col("_width"), F.lit(" ")),
                 F.lit(" chunks) ["), F.col("doc_id").cast("string"), F.lit("]")).alias("line"),
    )


def longest_chunks(chunks: DataFrame, n: int = 10) -> DataFrame:
    return (
        chunks.select("chunk_id", F.length("content").alias("content_length"), "doc_id", "chunk_index")
        .orderBy(F.col("content_length").desc(), "chunk_id").limit(n)
    )


def chunk_preview(chunks: DataFrame, n: int = 20, width: int = 120) -> DataFrame:
    return (
        chunks.select("chunk_id", F.left("content", F.lit(width)).alias("content_preview"), "doc_id", "chunk_index")
        .orderBy("doc_id", "chunk_index", "chunk_id").limit(n)
    )


def document_chunks(chunks: DataFrame, doc_id, width: int = 150) -> DataFrame:
    """One document's chunks in order; the id test reaches the scan."""
    return (
        chunks.filter(F.col("doc_id") == doc_id)
        .select("chunk_id", F.left("content", F.lit(width)).alias("content_preview"), "chunk_index")
        .orderBy("chunk_index")
    )


def opening_chunks(documents: DataFrame, chunks: DataFrame, n: int = 1) -> DataFrame:
    """The first ``n`` chunks of every row of ``documents``, which stays if it has none: its columns, ``chunk_id, chunk_index``.

    A lateral join with a limit per outer row; Spark ranks each document's chunks before the shuffle and keeps ``n`` of a task.
    """
    # The outer column has a name of its own, else the inner one would be taken.
    outer = documents.withColumn("_document", F.col("doc_id"))
    own = chunks.where(F.col("doc_id") == F.col("_document").outer()).orderBy("chunk_index", "chunk_id").limit(n)
    return outer.lateralJoin(own.select("chunk_id", "chunk_index"), how="left").drop("_document")
