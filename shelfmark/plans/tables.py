"""The input tables and the chunk store the registered queries share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedders import HashingEmbedder
from ..model import Variant
from ..operators.ann import VectorIndex
from ..operators.chunking import chunk, embed_chunks
from ..operators.lexical_index import build_lexical_index
from ..session import fresh_dir, spread

FIXED = Variant("fixed_512_128", "fixed", 512, 128)
TOKEN = Variant("token_512_64", "token", 512, 64)
RECURSIVE = Variant("recursive_512_64", "recursive", 512, 64)
SEMANTIC = Variant("semantic_512_64", "semantic", 512, 64)
# Tables whose rows are long texts, worth spreading before they are read.
HEAVY = ("documents", "pages", "conversations")
CELLS = 16
_INDEXES: dict[tuple[str, str], str] = {}
VARIANTS = (FIXED, TOKEN, RECURSIVE, SEMANTIC)


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in HEAVY else df

    def docs(self) -> DataFrame:
        """Documents with their columns as string metadata."""
        return self.documents.withColumn("metadata", F.create_map(
            F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"),
            F.lit("title"), F.left("text", F.lit(40))))

    def chunks(self, variant: Variant = FIXED) -> DataFrame:
        return chunk(self.docs(), variant, keep=["lang", "source"], metadata="metadata")

    def store(self) -> DataFrame:
        return embed_chunks(self.chunks())

    def lexical_index(self) -> str:
        """The index of all documents, written once for each table path in a session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _INDEXES:
            path = fresh_dir(self.spark, "lexical")
            build_lexical_index(self.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), path)
            _INDEXES[key] = path
        return _INDEXES[key]

    def vector_index(self) -> VectorIndex:
        """The index of all vectors, written once; a third of them come in by a second insertion."""
        key = (self.spark.sparkContext.applicationId, f"vectors {self.sf_dir}")
        if key not in _INDEXES:
            index = VectorIndex(self.spark, fresh_dir(self.spark, "vectors"))
            index.fit(self.vectors(), CELLS)
            index.insert(self.vectors().filter("chunk_id % 3 <> 0"))
            index.insert(self.vectors().filter("chunk_id % 3 = 0"))
            _INDEXES[key] = index.path
        return VectorIndex(self.spark, _INDEXES[key])

    def questions(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))

    def asked(self) -> DataFrame:
        return self.questions().withColumn("embedding", HashingEmbedder().embed(F.col("question")))

    def vectors(self) -> DataFrame:
        """The embeddings table in the shape of a store; its label stands for a document."""
        return self.embeddings.select(
            F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("doc_id"), "label")

    def vector_questions(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("query_id"), "embedding", "label")

    def page_urls(self) -> DataFrame:
        """Page URLs with the root of their own site as the start."""
        from ..functions.urls import origin

        return self.pages.select(
            "page_id", "url", F.concat(origin(F.col("url")), F.lit("/")).alias("start"),
            F.col("page_id").alias("pos"))

    def user_events(self) -> DataFrame:
        return self.events.withColumn("ts", F.col("ts").cast("timestamp"))
