"""BM25 over a whole corpus, by a stored inverted index in layers of impact.

A posting's weight, what BM25 makes of the word's count and the text's length, lies between fixed bounds whatever the word.
Postings are dealt to ``LAYERS`` by their weight and stored in blocks of one term and layer, greatest weights first, so
a search skips the row groups of others. The index is three Parquet tables in one folder: ``postings``; ``layers``
with the number of postings and the greatest weight of each block; and ``corpus`` with the number of texts and their mean length.

A search never scores what cannot win. The blocks of greatest impact give every question a threshold: the ``k``-th best
sum found there, which no full score of those texts is below. From the block table alone follows how deep each term
has to be read so that a text met in none of the blocks read stays under the threshold. The texts met there, less those
that their unread words cannot lift over it, are completed from the other blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let, unnest, word_tokens
from ..session import materialize
from .ranking import BM25_DELTA, BM25_K1, _idf, bm25_weight

LAYERS = 64
BUCKET_TEXTS = 1 << 20   # a frequent term's postings are split so
PROBED = 32              # one of so many postings is probed for the threshold, and at least eight times as many as are asked for
WORTH = 5
FULL = 1 << 20
SLACK = 2e-9             # scores are compared with nine decimals


def term_counts(tokens: Column) -> Column:
    """Distinct tokens with their number, by one sort inside the row."""
    def runs(s: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda t, i: F.struct(t.alias("term"), i.alias("at"))),
                          lambda x: (x["at"] == 0) | (F.get(s, x["at"] - 1) != x["term"]))
        return let(firsts, lambda f: F.transform(f, lambda x, j: F.struct(
            x["term"].alias("term"), (F.coalesce(F.get(f, j + 1)["at"], F.size(s)) - x["at"]).alias("tf"))))

    return let(F.sort_array(tokens), runs)


def _layer(weight: Column) -> Column:
    """0 for the greatest weights."""
    span = BM25_K1 + 1.0
    return F.least(F.floor((span + BM25_DELTA - weight) * (LAYERS / span)), F.lit(LAYERS - 1)).cast("int")


def build_lexical_index(chunks: DataFrame, path: str, content: str = "content") -> None:
    """Index ``chunk_id`` and ``content``. Texts without words count in the corpus and have no postings."""
    spark = chunks.sparkSession
    tokens = chunks.select("chunk_id", word_tokens(F.col(content)).alias("tokens"))
    words = materialize(tokens.select("chunk_id", F.size("tokens").alias("length"), term_counts(F.col("tokens")).alias("counts")), "words")
    words.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).write.parquet(f"{path}/corpus")
    corpus = spark.read.parquet(f"{path}/corpus").first()
    postings = unnest(words, ["chunk_id", "length"], "counts", "at", "c").select(
        F.col("c.term").alias("term"), "chunk_id", bm25_weight(F.col("c.tf"), F.col("length"), F.lit(corpus["mean"])).alias("weight"))
    # A term that most texts hold goes to several tasks.
    split = F.pmod(F.xxhash64("chunk_id"), F.lit(1 + corpus["n"] // BUCKET_TEXTS))
    postings.withColumn("layer", _layer(F.col("weight"))).repartition("term", split).sortWithinPartitions("term", "layer").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("term", "layer").agg(
        F.count(F.lit(1)).alias("n"), F.max("weight").alias("top")).write.parquet(f"{path}/layers")


def _depths(found: pa.Table) -> pa.Table:
    """How deep to read the terms of one question, given its blocks (``term, idf, layer, n, impact, threshold``).

    A price is put on the impact left unread, and every term read as deep as is then cheapest, postings read included; of a
    grid of prices the least is taken at which all that is left stays under the threshold. What that leaves spare then makes
    terms less deep, those with most postings first. A question that would read more than one in ``WORTH`` of its postings
    reads them all, which costs less than completing the texts met.
    """
    names = found["term"].combine_chunks().dictionary_encode()
    terms, place = names.dictionary, names.indices.to_numpy()
    n, impact = np.zeros((2, len(terms), LAYERS))
    layer, idf = found["layer"].to_numpy(), np.zeros(len(terms))
    n[place, layer], impact[place, layer], idf[place] = found["n"].to_numpy(), found["impact"].to_numpy(), found["idf"].to_numpy()
    threshold = found["threshold"][0].as_py() - SLACK
    zero = np.zeros((len(terms), 1))
    read = np.concatenate([zero, n.cumsum(1)], axis=1)
    left = np.concatenate([np.maximum.accumulate(impact[:, ::-1], axis=1)[:, ::-1], zero], axis=1)
    every = np.arange(len(terms))
    prices = np.geomspace(1e-3, 1e4 * max(1.0, n.sum()), 96)
    low, high, depth = 0, len(prices), np.full(len(terms), LAYERS)
    while low < high:
        middle = (low + high) // 2
        chosen = (read + prices[middle] * left).argmin(1)
        if left[every, chosen].sum() < threshold:
            high, depth = middle, chosen
        else:
            low = middle + 1
    spare = threshold - left[every, depth].sum()
    for t in np.argsort(-read[every, depth], kind="stable"):
        # Less may do, where a price leaps over it: the first depth at which what is left takes no more than is spare.
        less = int((left[t] - left[t, depth[t]] < spare).argmax())
        spare -= left[t, less] - left[t, depth[t]]
        depth[t] = less
    if WORTH * read[every, depth].sum() > n.sum():
        depth = np.full(len(terms), LAYERS)
    return pa.table({"query_id": found["query_id"][:1].take(pa.array(np.zeros(len(terms), np.int64))), "term": terms, "idf": idf, "depth": (depth - 1).astype(np.int32),
                     "left": left[every, depth], "n_read": read[every, depth].astype(np.int64), "n": n.sum(1).astype(np.int64),
                     "threshold": np.full(len(terms), threshold + SLACK)})


def search_depths(spark: SparkSession, path: str, questions: DataFrame, k: int, full: int = FULL) -> DataFrame:
    """``query_id, term, idf, depth, left, n_read, n, threshold``: how deep each term of a question is read, out of how much.

    Questions of up to ``full`` postings are read in full, as planning them would cost more.
    """
    corpus = spark.read.parquet(f"{path}/corpus").first()
    asked = questions.select("query_id", F.explode(F.array_distinct(word_tokens(F.col("question")))).alias("term"))
    question = Window.partitionBy("query_id")
    table = spark.read.parquet(f"{path}/layers")
    terms = table.join(asked, "term").groupBy("query_id", "term").agg(F.sum("n").alias("n")).withColumn(
        "idf", _idf(F.lit(corpus["n"]), F.col("n"))).withColumn("all", F.sum("n").over(question))
    terms = materialize(terms, "terms")
    whole = terms.filter(F.col("all") <= full).select(
        "query_id", "term", "idf", F.lit(LAYERS - 1).alias("depth"), F.lit(0.0).alias("left"), F.col("n").alias("n_read"), "n", F.lit(0.0).alias("threshold"))
    planned = terms.filter(F.col("all") > full)
    if planned.isEmpty():
        return whole
    ahead = F.sum("n").over(question.orderBy(F.desc("impact"), "term", "layer").rowsBetween(Window.unboundedPreceding, -1))
    blocks = table.join(planned.drop("n"), "term").withColumn("impact", F.col("idf") * F.col("top"))
    blocks = materialize(blocks.withColumn("ahead", F.coalesce(ahead, F.lit(0))), "blocks")
    probes = blocks.filter(F.col("ahead") < F.greatest(F.lit(8 * k), F.col("all") / PROBED)).select("query_id", "term", "layer", "idf")
    sums = spark.read.parquet(f"{path}/postings").join(probes, ["term", "layer"]).groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("idf") * F.col("weight")).alias("score"))
    ranked = sums.withColumn("r", F.row_number().over(question.orderBy(F.desc("score")))).filter(F.col("r") <= k)
    thresholds = ranked.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("threshold"))
    # Without ``k`` texts there is nothing to stay under.
    known = blocks.join(thresholds, "query_id", "left").select(
        "query_id", "term", "idf", "layer", "n", "impact", F.coalesce("threshold", F.lit(0.0)).alias("threshold"))
    return whole.unionByName(known.repartition(spark.sparkContext.defaultParallelism, "query_id").groupBy("query_id").applyInArrow(_depths, whole.schema))


def lexical_search(spark: SparkSession, path: str, questions: DataFrame, k: int, full: int = FULL) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the ``k`` best texts of every ``query_id, question``.

    Only texts that hold one of a question's words are ranked; ties go to the lower id. ``query_id`` names one question.
    """
    postings = spark.read.parquet(f"{path}/postings")
    depths = materialize(search_depths(spark, path, questions, k, full), "depths")
    read = postings.join(depths, "term").filter(F.col("layer") <= F.col("depth"))
    met = read.groupBy("query_id", "chunk_id").agg(F.sum(F.col("idf") * F.col("weight")).alias("score"), F.sum("left").alias("met_left"))
    limits = depths.groupBy("query_id").agg(F.sum("left").alias("all_left"), F.first("threshold").alias("threshold"))
    able = met.join(limits, "query_id").filter(F.col("score") + F.col("all_left") - F.col("met_left") >= F.col("threshold") - SLACK)
    able = able.select("query_id", "chunk_id", "score")
    unread = depths.filter("left > 0").select("query_id", "term", "idf", "depth")
    if unread.isEmpty():
        return _ranked(able, k)
    able = materialize(able, "candidates")
    rest = able.select("query_id", "chunk_id").join(unread, "query_id").join(postings, ["term", "chunk_id"]).filter(F.col("layer") > F.col("depth"))
    parts = able.unionByName(rest.select("query_id", "chunk_id", (F.col("idf") * F.col("weight")).alias("score")))
    return _ranked(parts, k)


def _ranked(parts: DataFrame, k: int) -> DataFrame:
    # Weights are rounded together, so the order of adding them does not matter.
    scored = parts.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
