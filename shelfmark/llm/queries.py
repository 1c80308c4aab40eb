"""The operators applied to their whole tables, with the settings meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import audit, balltree, decontam, langid, lm, neardup, pieces, pii, quality, ranked, secrets, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_sentencepiece(table):
    return pieces.encode(table("documents"))


@query
def op2_ball_tree(table):
    vectors = table("embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), balltree.integral(F.col("embedding")).alias("v"))
    asked = vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return balltree.search(balltree.build_index(vectors), asked, 5).select("query_id", "rank", "vec_id", "score")


@query
def op3_decontaminate(table):
    found = decontam.contamination(table("documents"), table("benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op4_language(table):
    docs = table("documents")
    model = langid.fit(docs, ~langid.held_out())
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op5_superminhash(table):
    found = neardup.near_duplicates(table("documents"), shingle=3, percent=85, band_rows=7)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op6_toxicity(table):
    found = toxicity.scored(table("documents"), table("labels"), ~toxicity.held_out())
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op7_secret_scan(table):
    found = secrets.scan_versions(table("documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    count = lambda n: F.size(F.filter("spans", lambda s: s["rank"] == n)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


@query
def op8_token_counts(table):
    return tokens.count_tokens(table("documents"))


@query
def op9_language_model(table):
    found = lm.scored(table("documents"), ~lm.held_out())
    return found.select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op10_quality(table):
    found = quality.scored(table("documents"), table("labels"), ~quality.held_out())
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query
def op11_pii(table):
    found = pii.find(table("documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(pii.BASE))
    count = lambda n: F.size(F.filter("spans", lambda s: s["rank"] == n)).cast("long")
    return found.select(
        "doc_id", *[count(n).alias(f"n_{kind.name}") for n, kind in enumerate(pii.BASE)],
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


@query
def op12_ranked_search(table):
    return ranked.search(table("documents"), table("benchmark"))


@query
def op13_filter_audit(table):
    return audit.audit(table("documents"), table("labels"))
