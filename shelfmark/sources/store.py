"""A chunk store on Parquet that grows by batches and is merged when read.

Parquet has no row-level update. So a change is appended as a numbered batch and nothing already stored is
rewritten: an upsert adds the new rows, a delete adds the ids of the documents. Beside its rows a batch has a slim table of
its chunk ids. When a batch comes in, its ids are looked up in those of the other batches, and the rows that do not count any
more are listed as superseded. A reader leaves out the listed rows by an anti join on id and batch: contents and vectors are
neither sorted nor compared, and a store in which nothing was replaced is read as it lies.

The ids of a batch are written last, and what has no ids yet is not read. Compaction folds the batches of a variant into
one, in files sized by their bytes. A batch that is written again under its number replaces itself, so replays change nothing.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import map_merge
from ..session import materialize


def latest_by_id(rows: DataFrame, sequence: str = "seq") -> DataFrame:
    """The newest row of every chunk id."""
    newest = Window.partitionBy("chunk_id").orderBy(F.col(sequence).desc())
    return rows.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", sequence)


def _one_per_id(rows: DataFrame) -> DataFrame:
    """The newest row per chunk id: by a ``seq`` column, else the last in the order of the rows."""
    if "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.monotonically_increasing_id())
    return latest_by_id(rows, "seq")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with ``new`` inserted, or replacing rows of equal chunk id.

    Replaced rows leave by an anti join on the id, which Spark broadcasts when the new
    batch is small, so a large store is neither sorted nor shuffled for a small update.
    """
    fresh = _one_per_id(new)
    return stored.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(
        fresh, allowMissingColumns=True)


def delete_documents(stored: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``stored`` without any chunk of the given documents; unknown ids change nothing."""
    return stored.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def delete_orphans(stored: DataFrame) -> DataFrame:
    return stored.filter(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "")


def with_store_metadata(chunks: DataFrame) -> DataFrame:
    """Write the document id and chunk index into the metadata, and require a vector."""
    extra = F.create_map(F.lit("documentId"), F.col("doc_id").cast("string"),
                         F.lit("chunkIndex"), F.col("chunk_index").cast("string"))
    vector = F.when(F.col("embedding").isNull(), F.raise_error(
        F.concat(F.lit("Chunk "), F.col("chunk_id"), F.lit(" has no embedding")))).otherwise(F.col("embedding"))
    base = F.col("metadata") if "metadata" in chunks.columns else F.expr("cast(map() as map<string,string>)")
    return chunks.withColumn("metadata", map_merge(base, extra)).withColumn("embedding", vector)


class ChunkStore:
    """Chunk tables of all variants below one path.

    ``rows`` and ``keys`` hold ``module / variant / batch`` partitions, ``superseded`` ``module / variant / by`` (the batch that
    made the list), ``deletes`` the ids deleted in a batch. The ``boot`` variant, a ``(module, variant)`` pair, cannot be dropped.
    """

    def __init__(self, spark: SparkSession, path: str, boot: tuple[str, str] | None = None) -> None:
        self.spark, self.path, self.boot = spark, path, boot

    def read(self, module: str | None = None, variant: str | None = None) -> DataFrame:
        """The stored chunks; naming a module or variant prunes partitions."""
        return self._current(module, variant).drop("batch", "pos", "seq")

    def _current(self, module: str | None, variant: str | None) -> DataFrame:
        wanted = lambda part: (module is None or part[0] == module) and (variant is None or part[1] == variant)
        held = {p for p in self._parts("keys", "batch") if wanted(p)}
        df = self.spark.read.option("mergeSchema", "false").parquet(f"{self.path}/rows")
        if module is not None:
            df = df.filter(F.col("module") == module)
        if variant is not None:
            df = df.filter(F.col("variant") == variant)
        df = self._without(df, "batch", {p for p in self._parts("rows", "batch") if wanted(p)} - held)
        lists = {p for p in self._parts("superseded", "by") if wanted(p)}
        if lists & held:
            listed = self._without(self.spark.read.parquet(f"{self.path}/superseded"), "by", lists - held)
            old = listed.select(*[F.col(c).alias(f"_{c}") for c in ("module", "variant", "batch", "chunk_id", "keep")])
            same = F.col("pos") != F.col("_keep")
            for c in ("module", "variant", "batch", "chunk_id"):
                same = same & (F.col(c) == F.col(f"_{c}"))
            df = df.join(old, same, "left_anti")
        if not self._batches("deletes/batch=*"):
            return df
        gone = self.spark.read.parquet(f"{self.path}/deletes").groupBy("doc_id").agg(F.max("batch").alias("_until")).withColumnRenamed(
            "doc_id", "_gone")
        return df.join(gone, (F.col("doc_id").cast("string") == F.col("_gone")) & (F.col("batch") < F.col("_until")), "left_anti")

    @staticmethod
    def _without(df: DataFrame, number: str, parts: set[tuple[str, str, int]]) -> DataFrame:
        for module, variant, n in sorted(parts):
            df = df.filter(~((F.col("module") == module) & (F.col("variant") == variant) & (F.col(number) == n)))
        return df

    def _parts(self, folder: str, number: str) -> list[tuple[str, str, int]]:
        """Module, variant and number of the partitions of a folder, by listing it."""
        names = lambda path: [unquote(x.partition("=")[2]) for x in path.split("/")[-3:]]
        found = [names(str(p)) for p in self._listed(f"{folder}/module=*/variant=*/{number}=*")]
        return [(module, variant, int(n)) for module, variant, n in found]

    def exists(self) -> bool:
        return bool(self._batches("rows/module=*/variant=*/batch=*"))

    def _listed(self, pattern: str) -> list:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(target)
        return [f.getPath() for f in found or []]

    def _batches(self, pattern: str) -> list[int]:
        return [int(p.getName().partition("=")[2]) for p in self._listed(pattern)]

    def _next(self) -> int:
        return 1 + max([-1, *self._batches("rows/module=*/variant=*/batch=*"), *self._batches("deletes/batch=*")])

    def _append(self, rows: DataFrame, batch: int, folder: str, *partitions: str) -> None:
        (rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partitions, "batch").parquet(f"{self.path}/{folder}"))

    def upsert(self, chunks: DataFrame, module: str = "basic", batch: int | None = None) -> None:
        """Add or replace chunks by id; the last row of an id in ``chunks`` counts, by ``seq`` if it has that.

        ``batch`` numbers the change where the caller may repeat it, such as a stream's epoch.
        """
        self._write(chunks, module, self._next() if batch is None else batch)

    def _write(self, chunks: DataFrame, module: str, number: int) -> None:
        seq = F.col("seq").cast("bigint") if "seq" in chunks.columns else F.lit(0).cast("bigint")
        rows = with_store_metadata(chunks).withColumn("module", F.lit(module)).withColumn("seq", seq).withColumn("pos", F.monotonically_increasing_id())
        self._append(rows, number, "rows", "module", "variant")
        # From here on only ids are read.
        own = self.spark.read.parquet(f"{self.path}/rows").filter((F.col("module") == module) & (F.col("batch") == number))
        last = F.max(F.struct("seq", "pos"))["pos"]
        keys = materialize(own.groupBy("variant", "chunk_id").agg(last.alias("keep"), F.count(F.lit(1)).alias("n")), "keys")
        all_rows = F.lit(-1).cast("bigint").alias("keep")
        listed = keys.filter("n > 1").select("variant", F.lit(number).alias("batch"), "chunk_id", "keep")
        if [p for p in self._parts("keys", "batch") if p[0] == module and p[2] != number]:
            others = self.spark.read.parquet(f"{self.path}/keys").filter((F.col("module") == module) & (F.col("batch") != number))
            older = others.filter(F.col("batch") < number).join(keys, ["variant", "chunk_id"], "left_semi").select("variant", "batch", "chunk_id", all_rows)
            # Only a batch that is written again has newer ones.
            newer = keys.join(others.filter(F.col("batch") > number), ["variant", "chunk_id"], "left_semi").select(
                "variant", F.lit(number).alias("batch"), "chunk_id", all_rows)
            listed = listed.unionByName(older).unionByName(newer)
        for path in self._listed(f"superseded/module={module}/variant=*/by={number}"):
            self._remove(path)
        listed.withColumn("module", F.lit(module)).withColumn("by", F.lit(number)).write.mode("append").partitionBy(
            "module", "variant", "by").parquet(f"{self.path}/superseded")
        self._append(keys.select(F.lit(module).alias("module"), "variant", "chunk_id"), number, "keys", "module", "variant")

    def delete(self, doc_ids: DataFrame, batch: int | None = None) -> None:
        """Remove the documents from every variant; unknown ids change nothing."""
        if self.exists():
            ids = doc_ids.select(F.col("doc_id").cast("string").alias("doc_id")).filter(F.col("doc_id").isNotNull()).distinct()
            self._append(ids, self._next() if batch is None else batch, "deletes")

    def compact(self, module: str, variant: str) -> None:
        """Fold a variant's batches into a new one; readers in between see the same rows from either."""
        part = f"module={module}/variant={variant}"
        old = self._batches(f"keys/{part}/batch=*")
        if not old:
            return
        # A scan deals files to tasks by their bytes, small ones together, so the rows need no shuffle to fill larger files.
        current = self._current(module, variant).drop("batch", "pos", "seq", "module")
        self._write(current, module, self._next())
        for batch in old:
            self._drop(f"keys/{part}/batch={batch}")
            self._drop(f"rows/{part}/batch={batch}")
        # All lists are about rows that are gone now.
        self._drop(f"superseded/{part}")

    def drop_variant(self, module: str, variant: str) -> None:
        if (module, variant) == self.boot:
            raise ValueError(f"{module}/{variant} is in use from the start and cannot be dropped")
        for folder in ("keys", "rows", "superseded"):
            self._drop(f"{folder}/module={module}/variant={variant}")

    def _drop(self, relative: str) -> None:
        self._remove(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{relative}"))

    def _remove(self, path) -> None:
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
