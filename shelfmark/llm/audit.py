"""Interaction audit of corpus filters by relations of failing ids.

Every filter stores one relation: the rows that fail it, with their part and whether a label calls them good or
toxic. What an order of filters does follows from these relations alone. Take a filter and the set of filters
before it, its prefix: the failing rows that no filter of the prefix fails (left anti join with the prefix's
relations) are removed by it, the others (left semi join) are redundant, and the survivors are what the removals leave.
Orders share prefixes, so each pair of a filter and a prefix set is joined once, all pairs in the same
two joins: a failing row meets the prefixes it is asked for, a fixed number of at most ``2 ** (n - 1)`` for ``n`` filters.

A filter is a condition over one text, or the copies of a text under larger ids. Texts are read once; relations
hold row numbers, given where the rows are first written, so rows that repeat an id are told apart.

Defined results: a null text is empty and a null part the empty string; a null id has no labels, is no copy and has
no copies; several labels of one id count if one of them holds; an empty table gives no rows. Equal texts are
those of equal SHA-256. A text that a third of all rows hold is reduced to its least id before the shuffle, and the join
that finds its copies is one Spark can split.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import fresh_dir, materialize

WORD = r"[^\x20\x09-\x0D]+"
COPIES = "E"


def text_filters() -> dict[str, Column]:
    """Failure conditions over ``text`` and its ``words``."""
    n, capitals = F.size("words"), F.regexp_count("text", F.lit("[A-Z]"))
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct("words")) * 100 < n * 50,
        "C": capitals.cast("long") * 100 > F.char_length("text").cast("long") * 3,
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def checked(docs: DataFrame, filters: dict[str, Column], part: str = "lang") -> DataFrame:
    """``row, doc_id, part, digest, failed`` of every row: its number, the text's SHA-256 and the filters it fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    failed = F.filter(F.array(*[F.when(fails, F.lit(name)) for name, fails in filters.items()]), lambda x: x.isNotNull())
    found = split.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), failed.alias("failed"))
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "checked")


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows whose text a smaller ``doc_id`` has."""
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    # Written, as Spark splits a large group of copies only in a join of two plain shuffles.
    firsts = materialize(firsts.select("digest", "first"), "firsts")
    return rows.join(firsts, "digest").filter("doc_id > first").drop("first")


def store_relations(rows: DataFrame, labels: DataFrame, copies: str | None = COPIES) -> DataFrame:
    """Write one relation per filter, ``row, part, good, toxic``, in a folder of its own; all of them, with ``filter``."""
    failing = rows.select("row", "doc_id", "part", F.explode("failed").alias("filter"))
    if copies:
        failing = failing.unionByName(later_copies(rows).select("row", "doc_id", "part", F.lit(copies).alias("filter")))
    marks = labels.select(
        F.col("doc_id").cast("long").alias("labelled"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic")).filter("good OR toxic").groupBy("labelled").agg(
            F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    marked = failing.join(marks, F.col("doc_id") == F.col("labelled"), "left").select(
        "filter", "row", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    path = fresh_dir(rows.sparkSession, "failing")
    marked.hint("rebalance", "filter").write.partitionBy("filter").parquet(path)
    return _relations(rows.sparkSession, path)


def _relations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row long, part string, good boolean, toxic boolean, filter string").parquet(path)


def prefix_effects(relations: DataFrame, names: list[str]) -> DataFrame:
    """``filter, prefix, part, removed, redundant, good_lost, toxic_lost`` of each filter behind each set of others.

    ``prefix`` is a bit mask over ``names``. Rows without any count are absent.
    """
    masks = range(1, 1 << len(names))
    chosen = lambda keep: F.explode(F.element_at(F.create_map(*itertools.chain.from_iterable(
        (F.lit(name), F.array(*[F.lit(m).cast("short") for m in masks if keep(m, 1 << i)])) for i, name in enumerate(names))), F.col("filter")))
    whole = (1 << len(names)) - 1
    asked = relations.select("filter", "part", "good", "toxic", "row", chosen(lambda m, bit: not m & bit).alias("prefix"))
    failed = relations.select("row", chosen(lambda m, bit: m & bit and m != whole).alias("prefix"))
    # Spark takes a side for as small as its files, without what the explosion adds, so it is told not to broadcast it.
    removed = asked.join(failed.hint("merge"), ["row", "prefix"], "left_anti")
    redundant = asked.join(failed.hint("merge"), ["row", "prefix"], "left_semi")
    one = lambda c: F.sum(F.col(c).cast("long")).alias(f"{c}_lost")
    counts = lambda df, prefix, which: df.groupBy("filter", prefix, "part").agg(
        F.count(F.lit(1)).alias(which), *([one("good"), one("toxic")] if which == "removed" else []))
    first = counts(relations.withColumn("prefix", F.lit(0).cast("short")), "prefix", "removed")
    both = first.unionByName(counts(removed, "prefix", "removed")).unionByName(counts(redundant, "prefix", "redundant"), allowMissingColumns=True)
    return both.groupBy("filter", "prefix", "part").agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("removed", "redundant", "good_lost", "toxic_lost")])


def orders(parts: DataFrame, names: list[str]) -> DataFrame:
    """``part, docs, filter_order, step, filter, prefix`` for all orders of the filters."""
    every = F.array(*[F.lit("".join(p)) for p in itertools.permutations(names)])
    steps = parts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bits = [F.when(before.contains(name), 1 << i).otherwise(0) for i, name in enumerate(names)]
    return steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1))).withColumn("prefix", sum(bits[1:], bits[0]).cast("short"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = COPIES, part: str = "lang") -> DataFrame:
    """What each filter does at each place of each order of the filters, in every part of ``docs``.

    ``filters`` names the conditions by one letter each; ``copies`` names the filter that later copies of a text fail.
    """
    filters = text_filters() if filters is None else filters
    names = [*filters, *([copies] if copies else [])]
    if not 0 < len(names) <= 8 or any(len(n) != 1 for n in names) or len(set(names)) < len(names):
        raise ValueError("one to eight filters, each named by a letter of its own")
    rows = checked(docs, filters, part)
    effects = materialize(prefix_effects(store_relations(rows, labels, copies), names), "effects")
    grid = orders(rows.groupBy("part").agg(F.count(F.lit(1)).alias("docs")), names)
    counted = grid.join(effects, ["part", "filter", "prefix"], "left").fillna(0, ["removed", "redundant", "good_lost", "toxic_lost"])
    order, same = Window.partitionBy("part", "filter_order"), Window.partitionBy("part", "filter")
    return counted.select(
        "part", "filter_order", "step", (F.col("docs") - F.sum("removed").over(order.orderBy("step"))).alias("kept"), "removed", "redundant",
        # Behind all the others a filter removes what fails it alone.
        F.max(F.when(F.col("step") == len(names), F.col("removed"))).over(same).alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum("removed").over(same).alias("shapley"))
