"""From raw hits to an answerable context: de-duplication, filters, BM25 and fusion.

Every group here is the candidate set of one question, at most a few hundred rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, map_merge, norm_content, word_tokens
from .vector_search import (DEFAULT_K, MAX_BLOCK_ROWS, MAX_FETCH, fetch_size, fetch_size_column, knn, max_hits,
                            question_table)

# Fixed values of the scoring formulas.
BM25_K1, BM25_B, BM25_DELTA = 1.2, 0.75, 0.5
RRF_K = 60
CANDIDATE_FACTOR = 4
BROADCAST_HITS = MAX_BLOCK_ROWS * MAX_FETCH
CONTEXT_SEPARATOR = "\n---\n"
NO_CONTEXT = "(no context retrieved)"
PROMPT = "Passages from the collection:\n\n%1$s\n\nReply to the following from these passages alone, or say that they do not tell.\n\n%2$s\n"


def attach(hits: DataFrame, chunks: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """Fetch chunk columns for hits.

    When ``most``, the number of hits there can be, proves the hits small they are broadcast, so the store is read
    once, column-pruned and unshuffled; otherwise Spark picks the join.
    """
    small = hits
    if most is not None and most <= BROADCAST_HITS:
        small = F.broadcast(hits)
    return chunks.select("chunk_id", *columns).join(small, "chunk_id")


def dedup_hits(hits: DataFrame, k: int | Column | None = None) -> DataFrame:
    """Keep the best-ranked hit of each distinct text, then the first ``k`` (None: all)."""
    limit = F.lit(k) if isinstance(k, int) else k
    same = Window.partitionBy("query_id", "_norm").orderBy("rank")
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        hits.withColumn("_norm", F.md5(norm_content(F.col("content"))))
        .withColumn("_first", F.row_number().over(same)).filter("_first = 1")
        .withColumn("rank", F.row_number().over(order)).filter(F.lit(True) if limit is None else F.col("rank") <= limit)
        .drop("_norm", "_first")
    )


def search(questions: DataFrame, chunks: DataFrame, k: int = DEFAULT_K,
           columns: list[str] | None = None, max_fetch: int | None = MAX_FETCH) -> DataFrame:
    """Over-fetch, drop repeated texts, keep ``k``: ``query_id, chunk_id, score, rank, ...``.

    At most ``max_fetch`` hits are fetched for a question unless it wants more; where a store holds many
    copies of a text, a larger bound, or None, leaves more distinct ones.

    A ``k`` column on the questions sets a limit per question, null meaning the default;
    a null or blank ``scope`` means the whole store.
    """
    columns = list(dict.fromkeys(["content", *(columns or ["doc_id"])]))
    own = "k" in questions.columns
    q = questions
    if "scope" in q.columns and dict(q.dtypes)["scope"] == "string":
        q = q.withColumn("scope", F.when(F.trim("scope") != "", F.col("scope")))
    if own:
        q = q.withColumn("_limit", F.coalesce("k", F.lit(k))).withColumn("k", fetch_size_column(F.col("_limit"), max_fetch))
    table = question_table(q)
    fetch = fetch_size(k, max_fetch)
    hits = knn(q, chunks, fetch, table=table)
    if own:
        hits = hits.join(q.select("query_id", "_limit"), "query_id")
    found = attach(hits, chunks, columns, max_hits(table, fetch))
    return dedup_hits(found, F.col("_limit") if own else k).drop("_limit")


def metadata_filter(hits: DataFrame, wanted: Mapping[str, object] | str | None) -> DataFrame:
    """Hits whose ``metadata`` equals every wanted entry; nothing wanted keeps all.

    ``wanted`` is a mapping, or the name of a map column holding each question's own.
    ``documentId`` and ``chunkIndex`` are matched too when those columns are present.
    """
    meta = F.col("metadata")
    stored = {"documentId": "doc_id", "chunkIndex": "chunk_index"}
    extra = [x for key, c in stored.items() if c in hits.columns
             for x in (F.lit(key), F.col(c).cast("string"))]
    if extra:
        meta = map_merge(meta, F.create_map(*extra))
    if wanted is None:
        return hits
    if isinstance(wanted, str):
        pairs = F.map_entries(F.coalesce(F.col(wanted), F.expr("cast(map() as map<string,string>)")))
        return hits.filter(F.forall(pairs, lambda e: F.element_at(meta, e["key"]).eqNullSafe(e["value"])))
    for key, value in wanted.items():
        hits = hits.filter(F.element_at(meta, F.lit(key)).eqNullSafe(F.lit(str(value))))
    return hits


def _idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, length: Column, avg_length: Column) -> Column:
    """What a term's count is worth, before its rarity; over ``BM25_DELTA`` and at most ``BM25_K1 + 1`` more."""
    return tf * (BM25_K1 + 1.0) / (tf + BM25_K1 * (1.0 - BM25_B + BM25_B * (length / avg_length))) + BM25_DELTA


def _bm25_term(n: Column, df: Column, tf: Column, length: Column, avg_length: Column) -> Column:
    return _idf(n, df) * bm25_weight(tf, length, avg_length)


def bm25(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Add ``bm25`` to candidates, with statistics of each question's candidates only.

    ``candidates`` holds ``query_id, chunk_id, content``; ``questions`` ``query_id, question``.
    Term counts are made in each candidate's row, for the question's terms alone; the rows
    of one question are then spread by term for the document frequencies and put together
    again, so the candidates are read once.
    """
    q = questions.select("query_id", F.array_distinct(word_tokens(F.col("question"))).alias("_terms"))
    per_question = Window.partitionBy("query_id")
    kept = [c for c in candidates.columns if c != "query_id"]

    def counts(tokens: Column) -> Column:
        return F.transform(F.array_distinct(tokens), lambda t: F.struct(
            t.alias("term"), F.size(F.filter(tokens, lambda x: x == t)).alias("tf")))

    asked = F.filter(F.col("_tokens"), lambda t: F.array_contains(F.col("_terms"), t))
    docs = (
        candidates.join(q, "query_id", "left")
        .withColumn("_tokens", word_tokens(F.col("content")))
        .withColumn("_length", F.size("_tokens"))
        .withColumn("_matched", let(asked, counts))
        .withColumn("_n", F.count(F.lit(1)).over(per_question))
        .withColumn("_avg", F.avg("_length").over(per_question))
    )
    spread = docs.select(
        "query_id", F.struct(*kept).alias("_c"), "_length", "_n", "_avg", F.explode_outer("_matched").alias("_m"))
    scored = spread.withColumn(
        "_df", F.count("_m.term").over(Window.partitionBy("query_id", "_m.term"))
    ).withColumn("_w", _bm25_term(F.col("_n"), F.col("_df"), F.col("_m.tf"), F.col("_length"), F.col("_avg")))
    return (
        scored.groupBy("query_id", F.col("_c.chunk_id").alias("_id"))
        .agg(F.first("_c").alias("_c"), F.coalesce(F.round(F.sum("_w"), 9), F.lit(0.0)).alias("bm25"))
        .select("query_id", "_c.*", "bm25")
    )


def rrf(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Add ``rrf``: reciprocal ranks of ``rank`` and of ``bm25``, ties in vector order."""
    order = Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), "rank")
    vector = Window.partitionBy("query_id").orderBy("rank")
    return (
        hits.withColumn("_v", F.row_number().over(vector))
        .withColumn("lexical_rank", F.row_number().over(order))
        .withColumn("rrf", F.round(1.0 / (k + F.col("_v")) + 1.0 / (k + F.col("lexical_rank")), 12))
        .drop("_v")
    )


def fuse(candidates: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Fused top ``k``; a question with at most ``k`` candidates keeps its vector order."""
    counted = candidates.withColumn("_count", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    ranked = rrf(bm25(counted, questions))
    fused = F.col("_count") > k
    order = Window.partitionBy("query_id").orderBy(
        F.when(fused, -F.col("rrf")).otherwise(F.lit(0.0)), "rank")
    return (
        ranked.withColumn("final_rank", F.row_number().over(order))
        .filter(F.col("final_rank") <= k)
        .withColumn("fused", fused)
        .withColumn("rank", F.col("final_rank"))
        .drop("_count", "final_rank")
    )


def hybrid_search(questions: DataFrame, chunks: DataFrame, k: int = DEFAULT_K, *,
                  where: Mapping[str, object] | None = None) -> DataFrame:
    """Vector candidates, metadata filter, then BM25 fused in by reciprocal rank.

    The filter runs after the vector fetch, so it never widens the candidates. Ask with
    a ``scope`` column to confine a question to one document.
    """
    columns = ["doc_id", "chunk_index"] + (["metadata"] if "metadata" in chunks.columns else [])
    found = search(questions.drop("k"), chunks, k * CANDIDATE_FACTOR, columns)
    return fuse(metadata_filter(found, where) if where else found, questions, k)


def merge_sources(results: DataFrame) -> DataFrame:
    """Union of result steps: each chunk once per question, where it first arrived."""
    first = results.groupBy("query_id", "chunk_id").agg(F.min(F.struct("step", "rank")).alias("_at"))
    order = Window.partitionBy("query_id").orderBy("_at")
    return first.select(
        "query_id", "chunk_id", F.col("_at.step").alias("step"), F.col("_at.rank").alias("rank"),
        F.row_number().over(order).alias("position"),
    )


def build_context(hits: DataFrame, questions: DataFrame, template: str = PROMPT) -> DataFrame:
    """One context text per question, best hit first, and the prompt made from it.

    ``template`` holds ``%1$s`` for the context and ``%2$s`` for the question.
    """
    joined = hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda h: h["content"]),
            CONTEXT_SEPARATOR,
        ).alias("context"),
        F.count(F.lit(1)).alias("sources"),
    )
    context = F.when(F.coalesce("context", F.lit("")) == "", F.lit(NO_CONTEXT)).otherwise(F.col("context"))
    prompt = F.format_string(template, F.col("context"), F.col("question"))
    return (
        questions.select("query_id", "question").join(joined, "query_id", "left")
        .select("query_id", "question", context.alias("context"),
                F.coalesce("sources", F.lit(0)).alias("sources"))
        .withColumn("prompt", prompt)
    )
