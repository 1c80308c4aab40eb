"""Rates, percentiles and cost over an event table (``ts`` a TIMESTAMP)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CHARS_PER_TOKEN

WINDOW = "5 minutes"
SLIDE = "1 minute"
_ACCURACY = 10_000
_MARGIN = 10 / _ACCURACY


def rates(events: DataFrame, keys: list[str], window: str = WINDOW, slide: str | None = SLIDE) -> DataFrame:
    """Events per second in sliding windows, by ``keys``. Usable on streams as well."""
    when = F.window("ts", window, slide) if slide else F.window("ts", window)
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return (
        events.groupBy(when.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events",
                F.round(F.col("events") / seconds, 9).alias("rate"),
                F.round(F.col("total") / seconds, 6).alias("value_rate"))
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """Nearest-rank percentiles per group, exact, without gathering any group.

    A sketch first gives bounds around each percentile; a second pass counts the values
    below and keeps only those between the bounds, a small share even of a hot group. The
    true value is then picked by a running count over those.
    """
    clip = lambda p: min(max(p, 0.0), 1.0)
    points = [clip(p / 100 + d) for p in wanted.values() for d in (-_MARGIN, _MARGIN)]
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    bounds = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(value, [float(p) for p in points], _ACCURACY).alias("_b"))
    # Null keys are groups too, so the join back must match them.
    joined = rows.alias("r").join(
        bounds.alias("b"), [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    ).select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col(f"r.{value}").alias(value), "_n", "_b")

    def between(i: int) -> Column:
        return (F.col(value) >= F.col("_b")[2 * i]) & (F.col(value) <= F.col("_b")[2 * i + 1])

    places = range(len(wanted))
    near = F.lit(False)
    for i in places:
        near = near | between(i)
    # Values between no bounds only matter by how many lie below each percentile's range.
    slim = joined.withColumn("_v", F.when(near, F.col(value))).groupBy(*keys, "_v", "_n", "_b").agg(
        F.count(F.lit(1)).alias("_c"),
        *[F.count_if(F.col(value) < F.col("_b")[2 * i]).alias(f"_below{i}") for i in places])
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = slim
    for i, p in enumerate(wanted.values()):
        inside = (F.col("_v") >= F.col("_b")[2 * i]) & (F.col("_v") <= F.col("_b")[2 * i + 1])
        reach = F.sum(F.when(inside, F.col("_c")).otherwise(0)).over(upto) + F.sum(f"_below{i}").over(group)
        rank = F.greatest(F.lit(1), F.ceil(F.lit(p) / 100.0 * F.col("_n")))
        ranked = ranked.withColumn(f"_hit{i}", F.when(inside & (reach >= rank), F.col("_v")))
    return ranked.groupBy(*keys).agg(
        F.max("_n").alias("n"), *[F.min(f"_hit{i}").alias(name) for i, name in enumerate(wanted)])


def window_percentiles(events: DataFrame, keys: list[str], wanted: Mapping[str, float] | None = None,
                       window: str = WINDOW) -> DataFrame:
    """p50 and p95 of ``value`` in tumbling windows, by ``keys``."""
    wanted = wanted or {"p50": 50.0, "p95": 95.0}
    placed = events.withColumn("window_start", F.window("ts", window)["start"])
    return exact_percentiles(placed, ["window_start", *keys], "value", wanted)


def token_count(text: Column) -> Column:
    """Four characters make a token, roughly."""
    return F.floor(F.length(text) / CHARS_PER_TOKEN)


def token_cost(usage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cost per provider of token usage at prices per million tokens.

    Usage is summed per model before it meets the price list.
    """
    summed = usage.groupBy("provider_id", "model_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    priced = summed.join(
        catalog.select("provider_id", "model_id", "cost_input", "cost_output"), ["provider_id", "model_id"], "left")
    cost = (
        F.col("input_tokens") * F.coalesce("cost_input", F.lit(0.0))
        + F.col("output_tokens") * F.coalesce("cost_output", F.lit(0.0))
    ) / 1_000_000
    return priced.groupBy("provider_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum(cost), 6).alias("cost"))
