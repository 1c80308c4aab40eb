"""A stored inverted-file index of vectors with product-quantised codes.

A vector, scaled to length one, belongs to the cell of its nearest centre; what it differs from the centre is cut into
parts, and every part stored as the number of the nearest vector of that part's codebook. Rows lie in one folder per cell, with
their code and the vector itself. Centres and codebooks are fitted once, on a
bounded sample chosen by a hash of the id; rows are added at any time without fitting anew.

A search reads the codes of the probed cells only. A table of products of the question's parts with the codebooks gives the
score of a row's approximation; a few times as many rows as are asked for go on by it, and are scored on their vectors. A search
can also pass over the codes and read the vectors of the probed cells: then the answer is exact within these, and with all
cells probed it is that of :func:`~.vector_search.knn`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine
from ..session import materialize
from .vector_search import SCORE_DIGITS, QuestionBlock, _arrow_schema, _Best, _hit_schema, _matrices

DEFAULT_CELLS = 100
SAMPLE = 1 << 14           # vectors the index is fitted on
SAMPLE_BYTES = 64 << 20
CODES = 256
PART = 4                   # dimensions of a vector in one code
REFINE = 4
BLOCK_ROWS = 1 << 14       # questions that a task holds
TASK_ROWS = 1 << 17        # rows that a task multiplies with them, of a search by vectors
SLICE, SLAB = 256, 8192    # questions and rows whose products exist at a time
HELD = 1 << 20             # candidates of a task before those below the floor are let go


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _nearest(rows: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    """Number of the nearest centre, the lower one of equally near."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(half - rows[a:a + step] @ centres.T).argmin(1) for a in range(0, len(rows), step)] or [np.zeros(0, np.int64)])


def _centres(rows: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """At most ``n`` centres of rows by Lloyd's rounds; a centre that loses all its rows moves to the row farthest from its own."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:n]]
    if len(distinct) <= n:
        return centres
    for _ in range(rounds):
        own = _nearest(rows, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(sizes == 0)
        far = np.argsort(((rows - centres[own]) ** 2).sum(1))[::-1]
        centres = sums / np.maximum(sizes, 1)[:, None]
        centres[empty] = rows[far[:len(empty)]]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """``centres`` of cells, and for every part of a vector its codebook (``books``: part, code, dimension)."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def parts(self, rows: np.ndarray) -> np.ndarray:
        """Rows cut into parts, the last one filled up with zeros."""
        padded = np.zeros((len(rows), len(self.books) * self.books.shape[2]))
        padded[:, :rows.shape[1]] = rows
        return padded.reshape(len(rows), *self.books.shape[::2])

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes of unit vectors."""
        cells = _nearest(unit, self.centres)
        rest = self.parts(unit - self.centres[cells])
        codes = np.stack([_nearest(rest[:, p], book) for p, book in enumerate(self.books)], axis=1)
        return cells.astype(np.int32), codes.astype(np.uint8)

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """What centre and codes tell of rows of a cell."""
        rest = self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)
        return self.centres[cell] + rest[:, :self.dim]

    @classmethod
    def fit(cls, unit: np.ndarray, cells: int, seed: int = 42) -> "Quantiser":
        rng = np.random.default_rng(seed)
        centres = _centres(unit, cells, rng)
        rest = unit - centres[_nearest(unit, centres)]
        books = np.zeros((-(-unit.shape[1] // PART), CODES, PART))
        for p in range(len(books)):
            part = np.zeros((len(rest), PART))
            own = rest[:, p * PART:(p + 1) * PART]
            part[:, :own.shape[1]] = own
            found = _centres(part, CODES, rng)
            books[p] = found[np.arange(CODES) % len(found)]
        return cls(centres, books)


class VectorIndex:
    """Rows ``chunk_id, embedding`` below one path: ``rows`` in folders by cell, ``centres`` and ``books`` beside them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def fit(self, chunks: DataFrame, cells: int = DEFAULT_CELLS, seed: int = 42) -> None:
        """Fit centres and codebooks to at most about ``SAMPLE`` rows or ``SAMPLE_BYTES``."""
        rows = chunks.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
        if not seen["n"] or seen["least"] != seen["most"]:
            raise ValueError("an index is fitted to vectors of one length")
        wanted = min(SAMPLE, SAMPLE_BYTES // (8 * max(1, seen["most"])))
        share = F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = rows.filter(share < wanted / seen["n"]).orderBy(F.xxhash64("chunk_id")).toArrow() if seen["n"] > wanted else rows.orderBy("chunk_id").toArrow()
        matrix = next(m for _, m in _matrices(sample["embedding"]))
        model = Quantiser.fit(_unit(matrix), cells, seed)
        self._write("centres", [(i, v.tolist()) for i, v in enumerate(model.centres)], "number int, vector array<double>")
        self._write("books", [(p, c, v.tolist()) for p, book in enumerate(model.books) for c, v in enumerate(book)], "part int, code int, vector array<double>")

    def _write(self, name: str, rows: list, schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def quantiser(self) -> Quantiser:
        centres = self.spark.read.parquet(f"{self.path}/centres").orderBy("number").toArrow()
        books = self.spark.read.parquet(f"{self.path}/books").orderBy("part", "code").toArrow()
        matrix = lambda t: np.array(t["vector"].to_pylist(), dtype=np.float64)
        return Quantiser(matrix(centres), matrix(books).reshape(-1, CODES, PART))

    def insert(self, chunks: DataFrame) -> None:
        """Add rows of new ids, without fitting anew; rows without a vector are left out."""
        model = self.spark.sparkContext.broadcast(self.quantiser())
        rows = chunks.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
        kind = T.StructType(list(rows.schema.fields)).add("cell", "integer").add("codes", "binary")
        arrow = _arrow_schema(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, matrix in _matrices(batch.column("embedding")):
                    if matrix.shape[1] != model.value.dim:
                        raise ValueError(f"the index holds vectors of {model.value.dim} dimensions, not {matrix.shape[1]}")
                    cells, codes = model.value.encode(_unit(matrix))
                    own = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array(cells), pa.array([c.tobytes() for c in codes], pa.binary())], schema=arrow)

        # Spark sizes the files by their bytes and splits a cell that holds a third of all rows.
        rows.mapInArrow(run, kind).hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, questions: DataFrame, k: int, nprobe: int, refine: int | None = REFINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """``query_id, chunk_id, score, rank``: the best ``k`` rows of each question's ``nprobe`` nearest cells.

        ``refine`` times ``k`` rows by their approximation are scored exactly; None scores all rows by their vectors.

        Questions are taken in blocks of bounded size, each of which reads the codes, or vectors, of the cells it probes.
        """
        asked = questions.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
        blocks = max(1, -(-asked.count() // block_rows))
        order = Window.partitionBy("query_id")
        best = order.orderBy(F.desc("score"), "chunk_id")
        if refine is None:
            return self._by_vectors(asked, k, nprobe, blocks).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        kind = T.StructType([asked.schema["query_id"], self.rows().schema["chunk_id"]]).add("cell", "integer").add("low", "double")
        model, found, probed, keep = self.quantiser(), None, set(), k * refine
        for number in range(blocks):
            block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
            part, cells = self._candidates(block.toArrow(), model, keep, nprobe, kind)
            probed |= cells
            found = part if found is None else found.unionByName(part)
        # The last of the best scores of all tasks is a floor for all.
        floored = found.withColumn("r", F.row_number().over(order.orderBy(F.desc("low")))).withColumn(
            "floor", F.coalesce(F.max(F.when(F.col("r") == keep, F.col("low"))).over(order), F.lit(-2.0)))
        kept = floored.filter(F.col("low") >= F.col("floor")).select("query_id", F.col("chunk_id").alias("_id"), F.col("cell").alias("_cell"))
        vectors = self.rows().filter(F.col("cell").isin(sorted(probed))).select("chunk_id", "embedding", "cell")
        named = vectors.join(kept, (F.col("chunk_id") == F.col("_id")) & (F.col("cell") == F.col("_cell")))
        scored = named.join(asked.withColumnRenamed("embedding", "_question"), "query_id").select(
            "query_id", "chunk_id", F.round(cosine(F.col("_question"), F.col("embedding")), SCORE_DIGITS).alias("score"))
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def _probes(self, block: pa.Table, model: Quantiser, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of a block of questions, scaled to length one, and the numbers of the cells each of them probes."""
        vectors = [m for _, m in _matrices(block["embedding"])] or [np.zeros((0, model.dim))]
        if any(m.shape[1] != model.dim for m in vectors):
            raise ValueError(f"the index holds vectors of {model.dim} dimensions")
        unit = _unit(vectors[0])
        gap = (model.centres * model.centres).sum(1) / 2 - unit @ model.centres.T
        return unit, np.argsort(gap, axis=1, kind="stable")[:, :nprobe]

    def _by_vectors(self, asked: DataFrame, k: int, nprobe: int, blocks: int) -> DataFrame:
        """``query_id, chunk_id, score``: the best ``k`` rows of each question's probed cells, of every task."""
        model, rows = self.quantiser(), self.rows()
        kind = _hit_schema(asked, rows)
        arrow = _arrow_schema(kind)
        # A task with more rows has fewer hits to merge; its rows are bounded, and all cores have tasks.
        cores = self.spark.sparkContext.defaultParallelism
        tasks = max(-(-rows.count() // TASK_ROWS), -(-2 * cores // blocks))
        held = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        if blocks > 1:
            held = materialize(held.repartition("_block"), "asked", "_block")

        def searched(number: int) -> DataFrame:
            block = held.filter(F.col("_block") == number).select("query_id", "embedding").toArrow()
            unit, probes = self._probes(block, model, nprobe)
            everywhere = nprobe >= len(model.centres)
            shared = self.spark.sparkContext.broadcast((block["query_id"].combine_chunks(), unit, None if everywhere else probes))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names, unit, probes = shared.value
                best = _Best(QuestionBlock(names.to_pylist(), unit, np.full(len(unit), k), cells=None if probes is None else probes.tolist()))
                for batch in batches:
                    best.add(batch.column("chunk_id"), batch.column("embedding"), cell=None if probes is None else batch.column("cell").to_numpy())
                yield from best.table(arrow).to_batches()

            # Partition values, so folders of other cells are not read.
            read = rows.filter(F.col("cell").isin(np.unique(probes).tolist())).select("chunk_id", "embedding", *([] if everywhere else ["cell"]))
            return read.coalesce(tasks).mapInArrow(run, kind)

        return reduce(DataFrame.unionByName, map(searched, range(blocks)))

    def _candidates(self, block: pa.Table, model: Quantiser, k: int, nprobe: int, kind: T.StructType) -> tuple[DataFrame, set[int]]:
        """Rows of probed cells whose approximation reaches their task's floor, with its score; the cells."""
        arrow = _arrow_schema(kind)
        unit, probes = self._probes(block, model, nprobe)
        by_cell = {int(c): np.flatnonzero((probes == c).any(1)) for c in np.unique(probes)}
        # Small, as a worker keeps what it was sent: products with the codebooks are made where they are used.
        shared = self.spark.sparkContext.broadcast((block["query_id"], unit, model, by_cell))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, unit, model, by_cell = shared.value
            # The best scores of every question, and the k-th of them.
            lows, floor, held, n = np.full((len(unit), k), -np.inf), np.full(len(unit), -np.inf), [], 0

            def rise(asking: np.ndarray, q: np.ndarray, low: np.ndarray) -> None:
                every, value = np.concatenate([np.repeat(np.arange(len(asking)), k), q]), np.concatenate([lows[asking].ravel(), low])
                order = np.lexsort((-value, every))
                every, value = every[order], value[order]
                place = np.arange(len(every)) - np.searchsorted(every, every)
                lows[asking] = value[place < k].reshape(len(asking), k)
                floor[asking] = lows[asking, k - 1]

            for batch in batches:
                cells = batch.column("cell").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for cell in np.unique(cells).tolist():
                    whole = np.flatnonzero(cells == cell)
                    for own in np.split(whole, range(SLAB, len(whole), SLAB)):
                        known = model.decode(cell, codes[own])
                        for asking in np.split(by_cell[cell], range(SLICE, len(by_cell[cell]), SLICE)):
                            score = unit[asking] @ known.T
                            least = floor[asking]
                            fresh = np.flatnonzero(np.isneginf(least))
                            if len(fresh) and len(own) >= k:
                                # At least k of these rows reach the k-th score.
                                least[fresh] = np.partition(score[fresh], len(own) - k, axis=1)[:, len(own) - k]
                            q, r = np.nonzero(score >= least[:, None] - 10.0 ** -SCORE_DIGITS)
                            if not len(q):
                                continue
                            low = score[q, r]
                            rise(asking, q, low)
                            keep = low >= floor[asking[q]]
                            q, r, low = q[keep], r[keep], low[keep]
                            held.append((asking[q], batch.column("chunk_id").take(pa.array(own[r])), np.full(len(q), cell, np.int32), low))
                            n += len(q)
                            if n > HELD + len(unit) * k:
                                held = [(q[can], ids.filter(pa.array(can)), c[can], low[can]) for q, ids, c, low in held for can in [low >= floor[q]]]
                                n = sum(len(x[0]) for x in held)
                                # Rows that tie with the floor stay, so the next time may have to wait.
                                n = min(n, len(unit) * k)
            for q, ids, cell, low in held:
                keep = low >= floor[q]
                yield pa.RecordBatch.from_arrays(
                    [names.combine_chunks().take(pa.array(q[keep])).cast(arrow.field(0).type), ids.filter(pa.array(keep)), pa.array(cell[keep]),
                     pa.array(low[keep])], schema=arrow)

        # Partition values, so folders of other cells are not read.
        rows = self.rows().filter(F.col("cell").isin(sorted(by_cell))).select("chunk_id", "cell", "codes")
        # A task with more rows has higher floors and fewer candidates.
        return rows.coalesce(self.spark.sparkContext.defaultParallelism).mapInArrow(run, kind), set(by_cell)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, recall``: the share of each question's exact hits that were found."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("_hit"))
    return exact.join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("recall"))
