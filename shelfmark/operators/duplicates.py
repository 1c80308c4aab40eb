"""Finding documents that are already stored, by content or by source."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..functions.urls import url_key


def with_content_hash(docs: DataFrame, column: str = "text") -> DataFrame:
    return docs.withColumn("content_hash", content_hash(F.col(column)))


def tag_stores(stores: Mapping[str, DataFrame]) -> DataFrame:
    """Documents of several stores in one table, numbered in store order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        df.withColumn("module", F.lit(name)).withColumn("store_order", F.lit(i))
        for i, (name, df) in enumerate(stores.items())
    ])


def _first_match(stored: DataFrame, key: str) -> DataFrame:
    """One row per key: the match that comes first in store order, then by id.

    An aggregate of small structs combines before the shuffle, so a key shared by a
    large part of the store costs one row per task.
    """
    return (
        stored.filter(F.col(key).isNotNull()).groupBy(key)
        .agg(F.min(F.struct("store_order", F.col("doc_id").alias("match_id"), "module")).alias("_m"))
        .select(key, F.col("_m.match_id").alias("match_id"), F.col("_m.module").alias("match_module"))
    )


def find_by_content_hash(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming documents with the first stored document of equal content, if any."""
    return incoming.join(_first_match(stored, "content_hash"), "content_hash", "left")


def source_index(stored: DataFrame, source: str = "source") -> DataFrame:
    """URL key of every stored source with the first document that has it."""
    return _first_match(stored.withColumn("url_key", url_key(F.col(source))), "url_key")


def skip_known(incoming: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Only documents whose key is not stored yet; documents without a key pass."""
    return incoming.join(index, key, "left_anti")


def override_known(incoming: DataFrame, index: DataFrame, store: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The store without the documents that ``incoming`` replaces, and what to ingest."""
    replaced = index.join(incoming.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi")
    kept = store.join(replaced.select(F.col("match_id").alias("doc_id")), "doc_id", "left_anti")
    return kept, incoming


def dedup_in_batch(docs: DataFrame, order: str | Column = "doc_id", *, doc_id: str = "doc_id") -> DataFrame:
    """The first document of every content within a batch; a null hash never matches.

    Only hashes and ids are grouped, with a map-side minimum, so neither the texts nor
    all copies of a popular one are gathered anywhere.
    """
    order = F.col(order) if isinstance(order, str) else order
    slim = docs.select("content_hash", F.struct(order.alias("o"), F.col(doc_id).alias("id")).alias("_at"))
    winners = (
        slim.filter(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("_at").alias("_at"))
        .select(F.col("_at.id").alias(doc_id))
    )
    unknown = docs.filter(F.col("content_hash").isNull())
    return docs.filter(F.col("content_hash").isNotNull()).join(winners, doc_id, "left_semi").unionByName(unknown)


def existing_sources(chunks: DataFrame, source: str = "source") -> DataFrame:
    """Distinct URL keys of the stored sources."""
    return chunks.select(url_key(F.col(source)).alias("url_key")).filter(F.col("url_key").isNotNull()).distinct()
