"""Retrieval quality of ranked hits against known relevance.

``hits`` has ``query_id, chunk_id, rank``; ``relevance`` has ``query_id, label`` and
``items`` has ``chunk_id, label``: a chunk is relevant when the labels agree, so no table
of all relevant pairs is ever built.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge(hits: DataFrame, questions: DataFrame, items: DataFrame) -> DataFrame:
    """Hits with ``relevant`` and ``total_relevant``, the number a question could find."""
    totals = items.groupBy("label").agg(F.count(F.lit(1)).alias("total_relevant"))
    asked = questions.select("query_id", F.col("label").alias("_want")).join(
        totals.withColumnRenamed("label", "_want"), "_want", "left")
    return (
        asked.join(hits, "query_id", "left")
        .join(items.select("chunk_id", F.col("label").alias("_got")), "chunk_id", "left")
        .withColumn("relevant", F.coalesce(F.col("_got") == F.col("_want"), F.lit(False)))
        .withColumn("total_relevant", F.coalesce("total_relevant", F.lit(0)))
        .drop("_got", "_want")
    )


def precision_recall(judged: DataFrame, k: int) -> DataFrame:
    """Per question: relevant share of the first ``k`` hits, and share of all relevant found."""
    inside = F.col("rank") <= k
    found, got = F.count_if(inside & F.col("relevant")), F.count_if(inside)
    total = F.max("total_relevant")
    ratio = lambda a, b: F.round(F.when(b == 0, F.lit(0.0)).otherwise(a / b), 6)
    return judged.groupBy("query_id").agg(
        ratio(found, got).alias("precision_at_k"), ratio(found, total).alias("recall_at_k"),
        F.coalesce(F.round(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), 6), F.lit(0.0))
        .alias("reciprocal_rank"))


def mrr(judged: DataFrame) -> DataFrame:
    """Mean over questions of one over the rank of the first relevant hit."""
    first = judged.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("_r"))
    return first.agg(F.round(F.avg(F.coalesce(1.0 / F.col("_r"), F.lit(0.0))), 6).alias("mrr"),
                     F.count(F.lit(1)).alias("questions"))


def compare_runs(runs: Mapping[str, DataFrame], k: int) -> DataFrame:
    """Mean precision, recall and MRR of several judged runs, one row each."""
    return reduce(DataFrame.unionByName, [
        precision_recall(judged, k).agg(
            F.lit(name).alias("method"),
            F.round(F.avg("precision_at_k"), 6).alias("precision_at_k"),
            F.round(F.avg("recall_at_k"), 6).alias("recall_at_k"),
            F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))
        for name, judged in runs.items()
    ])
