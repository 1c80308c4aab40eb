"""Compound questions: decomposition and step-wise retrieval without a language model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, jtrim, unnest
from ..functions.embedders import HashingEmbedder
from .ranking import merge_sources, search
from .vector_search import DEFAULT_K

# The connectors a question is split on, in this order.
CONNECTORS = (" and ", " then ", " but ", "; ", ";", "?", ".")
DEFAULT_MAX_STEPS = 3


def subqueries(question: Column) -> Column:
    """Distinct parts of a question in order; none for a blank question."""
    def cut(parts: Column, connector: str) -> Column:
        return F.flatten(F.transform(parts, lambda p: F.split(p, "\\Q%s\\E" % connector)))

    parts = reduce(cut, CONNECTORS, F.array(question))
    kept = F.filter(F.transform(parts, jtrim), lambda p: ~is_blank(p))
    return F.when(is_blank(question), F.expr("cast(array() as array<string>)")).otherwise(
        F.array_distinct(kept))


def plan_subqueries(questions: DataFrame) -> DataFrame:
    """``query_id, step, subquery``, one row per part of each question."""
    return unnest(questions, ["query_id"], subqueries(F.col("question")), "step", "subquery")


def plan_steps(questions: DataFrame, max_steps: int = DEFAULT_MAX_STEPS) -> DataFrame:
    """The text searched at each step: the parts in order, then the last one again.

    A question without parts is searched as it stands.
    """
    if max_steps <= 0:
        max_steps = DEFAULT_MAX_STEPS
    parts = subqueries(F.col("question"))
    plan = F.when(F.size(parts) == 0, F.array(F.coalesce("question", F.lit("null")))).otherwise(parts)
    return (
        questions.select("query_id", plan.alias("_plan"))
        .select("query_id", "_plan", F.explode(F.sequence(F.lit(0), F.lit(max_steps - 1))).alias("step"))
        .select("query_id", "step",
                F.element_at("_plan", F.least(F.col("step") + 1, F.size("_plan"))).alias("subquery"))
    )


def _step_hits(steps: DataFrame, chunks: DataFrame, k: int, embedder) -> DataFrame:
    key = F.struct("query_id", "step")
    vector = (embedder or HashingEmbedder()).embed(F.col("subquery"))
    asked = steps.select(F.to_json(key).alias("query_id"), key.alias("_key"), vector.alias("embedding"))
    hits = search(asked.select("query_id", "embedding"), chunks, k)
    keys = asked.select("query_id", F.col("_key.query_id").alias("_q"), F.col("_key.step").alias("step"))
    return hits.join(keys, "query_id").drop("query_id").withColumnRenamed("_q", "query_id")


def multi_step_search(questions: DataFrame, chunks: DataFrame, k: int = DEFAULT_K,
                      max_steps: int = DEFAULT_MAX_STEPS, embedder=None) -> DataFrame:
    """Hits of the first step that found anything, per question.

    All steps of all questions are searched together, so the store is scanned once.
    """
    found = _step_hits(plan_steps(questions, max_steps), chunks, k, embedder)
    first = F.min("step").over(Window.partitionBy("query_id"))
    return found.withColumn("_first", first).filter(F.col("step") == F.col("_first")).drop("_first")


def gather_sources(questions: DataFrame, chunks: DataFrame, k: int = DEFAULT_K,
                   max_steps: int = DEFAULT_MAX_STEPS, embedder=None) -> DataFrame:
    """Sources of every planned part, each chunk once where it first arrived."""
    steps = plan_subqueries(questions).filter(F.col("step") < max_steps)
    return merge_sources(_step_hits(steps, chunks, k, embedder))
