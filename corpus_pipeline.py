"""From raw documents to token pieces: the stages of a training corpus, each an operator of ``shelfmark.llm``.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontam, neardup, pieces, quality, secrets
from shelfmark.llm.common import unused, without
from shelfmark.session import discard, fresh_dir, materialize, recorded, ship_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rule ensemble does not reject."""
    ship_package(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    ship_package(spark)
    with recorded() as steps:
        found = neardup.near_duplicates(docs, shingle=5, percent=80, band_rows=6)
    decided = materialize(found.select("doc_id", "row_key", "chosen", "n_shingles"), "decided")
    discard(spark, steps)
    left = without(docs, materialize(decided.filter(~F.col("chosen")), "dropped"))
    # A row that is there several times is a group of its own.
    again = decided.filter("chosen AND n_shingles > 0").groupBy("doc_id", "row_key").count().filter("count > 1")
    if again.isEmpty():
        return left
    name = unused(left, "row_key")
    keyed = left.withColumn(name, F.when(F.trim("text") != "", F.xxhash64("doc_id", "text")).otherwise(F.monotonically_increasing_id()))
    return keyed.dropDuplicates(["doc_id", name]).drop(name)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    ship_package(spark)
    with recorded() as steps:
        found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dropped = materialize(found.filter("n_hit > 0").select("doc_id", "row_key"), "dropped")
    discard(spark, steps)
    return without(docs, dropped)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the findings of the secret scan replaced by their kind in brackets."""
    ship_package(spark)
    blob, name = unused(docs, "blob"), unused(docs, "found")
    with recorded() as steps:
        found = secrets.scan_versions(docs).filter(F.size("spans") > 0).select("blob").distinct()
    flagged = materialize(found.select(F.col("blob").alias(name)), "flagged")
    discard(spark, steps)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A text no rule matches is in no finding, so it stays where it is; the others meet the findings.
    suspect = secrets.suspect(text)
    joined = docs.filter(suspect).withColumn(blob, F.sha2(text.cast("binary"), 256)).join(flagged, F.col(blob) == F.col(name), "left")
    hit = F.col(name).isNotNull()
    changed = joined.withColumn("text", F.when(hit, secrets.redacted(F.col("text"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(hit, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return docs.filter(~suspect).unionAll(changed.select(*[F.col(f"`{c}`") for c in docs.columns]))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The four best piece segmentations of every document."""
    ship_package(spark)
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", redact_secrets),
    ("sentencepiece", encode_pieces),
]

# Trained rules and piece lattices have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = fresh_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
