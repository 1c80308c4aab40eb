"""Exact cosine top-k for batches of questions.

The store is never joined to the questions pair by pair. Each task multiplies its
record batches with a block of question vectors and keeps only the best ``k`` chunks
per question; two small windows then merge the per-task winners, the first of them over
salted groups so that no single task receives the winners of every partition.

A block of questions travels to the tasks with the function, so its size is checked
first. More questions than ``MAX_BLOCK_ROWS`` take the tiled path, where questions
and chunks are hashed into tiles and cogrouped.

Scores are rounded to nine decimals and ties fall to the lower chunk id. The rank
therefore does not depend on how rows were partitioned or in which order a sum ran.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine

MAX_BLOCK_ROWS = 4096
MAX_BLOCK_BYTES = 64 << 20
TILE_ROWS = 50_000
MERGE_SALT = 64
SCORE_DIGITS = 9
OVERFETCH = 4
MAX_FETCH = 256
DEFAULT_K = 5
OPTIONS = ("k", "scope", "cells")
_SLICE = 256
_SLAB = 8192
_PAIRS = 1 << 16
_HEAD = 1024


def fetch_size(k: int, most: int | None = MAX_FETCH) -> int:
    """How many hits to fetch so that ``k`` survive the removal of repeated texts.

    ``most`` bounds what is fetched beyond ``k``; None lifts the bound.
    """
    if k <= 0:
        return 0
    if most is not None and k > most:
        return k
    return k * OVERFETCH if most is None else min(k * OVERFETCH, most)


def fetch_size_column(k: Column, most: int | None = MAX_FETCH) -> Column:
    """:func:`fetch_size` for a column of limits."""
    if most is None:
        return F.greatest(k * OVERFETCH, F.lit(0)).cast("int")
    return (
        F.when(k <= 0, F.lit(0))
        .when(k > most, k)
        .otherwise(F.least(k * OVERFETCH, F.lit(most)))
        .cast("int")
    )


@dataclass(frozen=True)
class QuestionBlock:
    """Question vectors grouped by length, with the rank limit and scope of each."""

    ids: list
    vectors: list[np.ndarray]
    limits: np.ndarray
    scopes: list | None = None
    cells: list | None = None

    @classmethod
    def from_table(cls, table: pa.Table, k: int) -> "QuestionBlock":
        col = lambda name: table.column(name).to_pylist() if name in table.column_names else None
        limits = col("k")
        return cls(
            ids=col("query_id"),
            vectors=[np.asarray(v, dtype=np.float64) for v in col("embedding")],
            limits=np.asarray([k if x is None else x for x in limits] if limits else [k] * table.num_rows,
                              dtype=np.int64),
            scopes=col("scope"),
            cells=col("cells"),
        )

    def by_dimension(self) -> dict[int, np.ndarray]:
        groups: dict[int, list[int]] = {}
        for i, v in enumerate(self.vectors):
            if self.limits[i] > 0:
                groups.setdefault(len(v), []).append(i)
        return {d: np.asarray(rows) for d, rows in groups.items()}


def _matrices(embeddings: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions and matrix for each vector length in a list array."""
    embeddings = embeddings.combine_chunks() if isinstance(embeddings, pa.ChunkedArray) else embeddings
    lengths = embeddings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = embeddings.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    for dim in np.unique(lengths):
        rows = np.nonzero(lengths == dim)[0]
        if len(rows) == len(lengths):
            yield rows, flat.reshape(len(rows), dim).astype(np.float64)
        else:
            yield rows, flat[starts[rows][:, None] + np.arange(dim)[None, :]].astype(np.float64)


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def _units(rows: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
    """Rows scaled to length one in single precision; rows of length zero stay zero."""
    norms = (_norms(rows) if norms is None else norms)[:, None]
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0).astype(np.float32)


def _slack(dim: int) -> np.float32:
    """What a product of two such rows may be off."""
    return np.float32((dim + 4) * 1.2e-7)


def _reaching(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of scores that reach their row's least, in order. They are few, so eight are looked at together."""
    n, width = scores.shape
    mask = np.zeros((n, -(-width // 8) * 8), dtype=bool)
    np.greater_equal(scores, least[:, None], out=mask[:, :width])
    words = mask.shape[1] // 8
    q, word = np.divmod(np.flatnonzero(mask.view(np.uint64)), max(1, words))
    at, bit = np.nonzero(mask.reshape(n, words, 8)[q, word])
    return q[at], word[at] * 8 + bit


def _exact(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray,
           na: np.ndarray | None = None, nb: np.ndarray | None = None) -> np.ndarray:
    """Rounded cosine of the pairs ``a[i], b[j]``, 0 where a norm is 0; few pairs are held at a time."""
    na, nb = _norms(a) if na is None else na, _norms(b) if nb is None else nb
    out = np.zeros(len(i))
    for at in range(0, len(i), _PAIRS):
        x, y = i[at:at + _PAIRS], j[at:at + _PAIRS]
        dots, scale = np.einsum("ij,ij->i", a[x], b[y]), na[x] * nb[y]
        np.divide(dots, scale, out=out[at:at + _PAIRS], where=scale > 0)
    return np.round(out, SCORE_DIGITS)


class _Slice:
    """A few questions of one vector length and one scope, with their best hits so far."""

    def __init__(self, members: np.ndarray, vectors: np.ndarray, limits: np.ndarray, cells: list | None = None) -> None:
        self.members, self.vectors, self.limits, self.cells = members, vectors, limits, cells
        self.floor = np.full(len(members), -np.inf)
        self.question, self.score, self.chunk = np.zeros(0, dtype=np.int64), np.zeros(0), None
        self.units: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def asking(self, cell: int) -> np.ndarray:
        """The questions that probe a cell."""
        return np.asarray([i for i, cells in enumerate(self.cells) if cell in cells], dtype=np.int64)

    def add(self, rows: np.ndarray, norms: np.ndarray, units: np.ndarray, asking: np.ndarray | None, names) -> None:
        """Take rows in whose product with a question, in single precision, can reach its floor."""
        m = units.shape[1]
        if m not in self.units:
            own = _norms(self.vectors[:, :m])
            self.units[m] = own, _units(self.vectors[:, :m], own)
        own, mine = self.units[m]
        floor = self.floor if asking is None else self.floor[asking]
        scores = (mine if asking is None else mine[asking]) @ units.T
        slack, k = _slack(m), int(self.limits.max())
        least = (floor - slack).astype(np.float32)
        least = np.where(np.isneginf(floor), least, np.nextafter(least, np.float32(-np.inf)))
        fresh = np.flatnonzero(np.isneginf(floor))
        head = min(len(units), max(_HEAD, 8 * k))
        if len(fresh) and head > k:
            # Of these rows at least k reach the k-th best product of the first of them less its error.
            least[fresh] = np.partition(scores[fresh, :head], head - k, axis=1)[:, head - k] - 2 * slack
        q, r = _reaching(scores, least)
        if len(q):
            q = q if asking is None else asking[q]
            self._merge(q, _exact(self.vectors[:, :m], q, rows[:, :m], r, own, norms), names(r))

    def _merge(self, q: np.ndarray, s: np.ndarray, names: np.ndarray) -> None:
        can = s >= self.floor[q]
        # Only the questions that gained a hit are ordered anew.
        gains = np.zeros(len(self.members), dtype=bool)
        gains[q[can]] = True
        old = gains[self.question]
        rest = None if self.chunk is None else (self.question[~old], self.score[~old], self.chunk[~old])
        q = np.concatenate([self.question[old], q[can]])
        s = np.concatenate([self.score[old], s[can]])
        names = names[can] if self.chunk is None else np.concatenate([self.chunk[old], names[can]])
        # Keys of one type sort natively; text ids become fixed-width unicode.
        keys = names.astype(str) if len(names) and isinstance(names[0], str) else names
        order = np.lexsort((keys, -s, q))
        q, s, names = q[order], s[order], names[order]
        starts = np.concatenate([[0], np.nonzero(np.diff(q))[0] + 1])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(q)]])))
        keep = place < self.limits[q]
        full = place == self.limits[q] - 1
        self.floor[q[full]] = s[full]
        best = q[keep], s[keep], names[keep]
        self.question, self.score, self.chunk = best if rest is None else (np.concatenate(x) for x in zip(rest, best))


class _Best:
    """Running top-k per question over the record batches of one task.

    Questions go by slices and rows by slabs, so that one bounded matrix of products exists at a time. It is made in single
    precision; only pairs that may be among the best are scored exactly.
    """

    def __init__(self, block: QuestionBlock) -> None:
        self.block = block
        self.slices: dict = {}  # by scope, None for the whole store
        for dim, members in block.by_dimension().items():
            scopes: dict = {}
            for i in members.tolist():
                scopes.setdefault(None if block.scopes is None else block.scopes[i], []).append(i)
            for scope, own in scopes.items():
                for start in range(0, len(own), _SLICE):
                    part = np.asarray(own[start:start + _SLICE])
                    vectors = np.stack([block.vectors[i] for i in part]).reshape(len(part), dim)
                    cells = None if block.cells is None else [set(block.cells[i]) for i in part]
                    self.slices.setdefault(scope, []).append(_Slice(part, vectors, block.limits[part], cells))

    def add(self, ids: pa.Array, embeddings: pa.Array, scope: list | None = None,
            cell: np.ndarray | None = None) -> None:
        names = np.asarray(ids.to_pylist(), dtype=object) if not pa.types.is_integer(ids.type) else ids.to_numpy(zero_copy_only=False)
        places: dict = {}
        for i, s in enumerate(scope or ()):
            if s in self.slices and s is not None:
                places.setdefault(s, []).append(i)
        for at, matrix in _matrices(embeddings):
            where = np.full(len(ids), -1)
            where[at] = np.arange(len(at))
            for wanted, slices in self.slices.items():
                if wanted is None:
                    own = np.arange(len(at))
                else:
                    own = where[np.asarray(places.get(wanted, []), dtype=np.int64)]
                    own = own[own >= 0]
                # Rows of one cell at a time, so that only the questions that probe it are multiplied.
                for number in [None] if cell is None else np.unique(cell[at[own]]).tolist():
                    of_cell = own if cell is None else own[cell[at[own]] == number]
                    asking = None if cell is None else [part.asking(number) for part in slices]
                    for start in range(0, len(of_cell), _SLAB):
                        mine = of_cell[start:start + _SLAB]
                        rows, units = matrix[mine], {}
                        for i, part in enumerate(slices):
                            if asking is not None and not len(asking[i]):
                                continue
                            m = min(rows.shape[1], part.vectors.shape[1])
                            if m not in units:
                                norms = _norms(rows[:, :m])
                                units[m] = norms, _units(rows[:, :m], norms)
                            part.add(rows, *units[m], None if asking is None else asking[i], lambda r, mine=mine: names[at[mine[r]]])

    def table(self, schema: pa.Schema) -> pa.Table:
        found = [part for parts in self.slices.values() for part in parts if part.chunk is not None]
        if not found:
            return schema.empty_table()
        return pa.table(
            [
                pa.array([self.block.ids[i] for part in found for i in part.members[part.question].tolist()], schema.field(0).type),
                pa.array([x for part in found for x in part.chunk.tolist()], schema.field(1).type),
                pa.array(np.concatenate([part.score for part in found]), pa.float64()),
            ],
            schema=schema,
        )


def _hit_schema(questions: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", questions.schema["query_id"].dataType),
        T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _arrow_schema(hits: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(hits)


def bounded_table(df: DataFrame, max_rows: int = MAX_BLOCK_ROWS,
                  max_bytes: int = MAX_BLOCK_BYTES) -> pa.Table | None:
    """``df`` as an Arrow table, or None when it is over the bound.

    At most ``max_rows + 1`` rows are ever brought to the driver.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > max_bytes:
        return None
    return table


def question_table(questions: DataFrame, max_rows: int = MAX_BLOCK_ROWS) -> pa.Table | None:
    """The questions as one bounded block, or None when there are too many."""
    optional = [c for c in OPTIONS if c in questions.columns]
    rows = questions.select("query_id", "embedding", *optional).filter(F.col("embedding").isNotNull())
    return bounded_table(rows, max_rows)


def max_hits(table: pa.Table | None, k: int) -> int | None:
    """The most hits a block of questions can have, or None when it has no bound."""
    if table is None:
        return None
    return int(QuestionBlock.from_table(table, k).limits.clip(0).sum())


def knn(questions: DataFrame, chunks: DataFrame, k: int, *, max_block_rows: int = MAX_BLOCK_ROWS,
        tile_rows: int = TILE_ROWS, table: pa.Table | None = None) -> DataFrame:
    """Best ``k`` chunks per question: ``query_id, chunk_id, score, rank``.

    ``questions`` has ``query_id`` and ``embedding``, and may have ``k`` (a limit of its
    own, null for the default), ``scope`` (a document id it is confined to) and
    ``cells`` (partition numbers it probes, matched with the chunks' ``cell``).
    ``chunks`` has ``chunk_id``, ``embedding`` and what those options refer to. A caller
    that already holds :func:`question_table` passes it as ``table``.
    """
    optional = [c for c in OPTIONS if c in questions.columns]
    questions = questions.select("query_id", "embedding", *optional).filter(F.col("embedding").isNotNull())
    wanted = ["chunk_id", "embedding"]
    if "scope" in optional:
        wanted.append("doc_id")
    if "cells" in optional:
        wanted.append("cell")
    chunks = chunks.select(*wanted).filter(F.col("embedding").isNotNull())
    schema = _hit_schema(questions, chunks)
    if k <= 0 and "k" not in optional:
        return chunks.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))

    table = table if table is not None else question_table(questions, max_block_rows)
    if table is not None:
        partial = _scan_with_block(chunks, QuestionBlock.from_table(table, k), schema)
    else:
        partial = _tiled(questions, chunks, k, schema, max_block_rows, tile_rows)

    # The salt is taken where the partial winners are made; a join on the question would bring them together.
    # Of a tiled search a question has one group of winners for each tile, which are few.
    partial = partial.withColumn("_salt", F.spark_partition_id() % MERGE_SALT if table is not None else F.lit(0))
    limit = F.lit(k)
    if "k" in optional:
        own = questions.select("query_id", F.coalesce("k", F.lit(k)).alias("_k"))
        partial = partial.join(own, "query_id")
        limit = F.col("_k")
    best = [F.col("score").desc(), F.col("chunk_id")]
    first = Window.partitionBy("query_id", "_salt").orderBy(*best)
    last = Window.partitionBy("query_id").orderBy(*best)
    if table is not None:
        partial = partial.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)
    return (
        partial.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= limit)
        .select("query_id", "chunk_id", "score", "rank")
    )


def _scan_with_block(chunks: DataFrame, block: QuestionBlock, schema: T.StructType) -> DataFrame:
    arrow = _arrow_schema(schema)
    scoped, celled = block.scopes is not None, block.cells is not None
    if scoped and all(s is not None for s in block.scopes):
        # Reaches the Parquet scan: only row groups that may hold these documents are read.
        chunks = chunks.filter(F.col("doc_id").isin(sorted(set(block.scopes))))
    if celled:
        # On a store partitioned by cell this prunes every cell that no question probes.
        probed = sorted({int(c) for cells in block.cells for c in cells})
        chunks = chunks.filter(F.col("cell").isin(probed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(block)
        for batch in batches:
            if batch.num_rows:
                best.add(
                    batch.column("chunk_id"), batch.column("embedding"),
                    batch.column("doc_id").to_pylist() if scoped else None,
                    batch.column("cell").to_numpy(zero_copy_only=False) if celled else None,
                )
        yield from best.table(arrow).to_batches()

    return chunks.mapInArrow(run, schema)


def _tiled(questions: DataFrame, chunks: DataFrame, k: int, schema: T.StructType,
           block_rows: int, tile_rows: int) -> DataFrame:
    """Blocks of questions against tiles of chunks, one cogroup each.

    Both sides are cut by a hash of their id, so a tile holds a bounded number of rows
    whatever the distribution of any other column; a cogroup emits at most ``k`` rows
    per question.
    """
    arrow = _arrow_schema(schema)
    scoped, celled = "scope" in questions.columns, "cells" in questions.columns
    n_tiles = max(1, -(-chunks.count() // tile_rows))
    # Every block is sent the whole store, so there are no more than bounded groups or busy cores ask for.
    asked = questions.count()
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-asked // tile_rows), min(-(-asked // block_rows), -(-4 * cores // n_tiles)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    # Named anew, for questions that were taken from the chunks share their columns.
    questions = questions.select(*[F.col(c).alias(c) for c in questions.columns])
    left = questions.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))).withColumn(
        "_tile", every(n_tiles))
    right = chunks.withColumn("_tile", F.pmod(F.xxhash64("chunk_id"), F.lit(n_tiles))).withColumn(
        "_block", every(n_blocks))

    def run(qs: pa.Table, cs: pa.Table) -> pa.Table:
        best = _Best(QuestionBlock.from_table(qs, k))
        if cs.num_rows and qs.num_rows:
            cs = cs.combine_chunks()
            for batch in cs.to_batches(max_chunksize=10_000):
                best.add(
                    batch.column("chunk_id"), batch.column("embedding"),
                    batch.column("doc_id").to_pylist() if scoped else None,
                    batch.column("cell").to_numpy(zero_copy_only=False) if celled else None,
                )
        return best.table(arrow)

    return (
        left.groupBy("_block", "_tile").cogroup(right.groupBy("_block", "_tile"))
        .applyInArrow(run, schema)
    )


def knn_one(vector: list[float], chunks: DataFrame, k: int, doc_id=None) -> DataFrame:
    """Top-k for one literal question vector, by a bounded sort in the JVM."""
    if doc_id is not None:
        chunks = chunks.filter(F.col("doc_id") == doc_id)
    literal = F.array(*[F.lit(float(x)) for x in vector])
    return (
        chunks.withColumn("score", F.round(cosine(literal, F.col("embedding")), SCORE_DIGITS))
        .orderBy(F.col("score").desc(), "chunk_id").limit(max(k, 0))
    )


def search_with_keyword(chunks: DataFrame, keyword: str, k: int = 5) -> DataFrame:
    """Chunks containing ``keyword`` in any case, nearest first to the first such chunk.

    "First" is the lowest chunk id; its vector, one value, is fetched and used as a literal.
    """
    escaped = keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    matches = chunks.filter(F.col("content").ilike(f"%{escaped}%"))
    first = matches.agg(F.min_by("embedding", "chunk_id").alias("v")).first()["v"]
    seed = F.array(*[F.lit(float(x)) for x in first]) if first else F.lit(None).cast("array<double>")
    return (
        matches.withColumn("distance", F.round(1.0 - cosine(F.col("embedding"), seed), SCORE_DIGITS))
        .orderBy("distance", "chunk_id").limit(k)
        .select("chunk_id", "doc_id", "chunk_index", F.left("content", F.lit(150)).alias("content_preview"),
                "distance")
    )


def pairwise_distance(chunks: DataFrame, limit: int = 15, *, tile_rows: int = 4096) -> DataFrame:
    """The ``limit`` closest pairs of chunks with ``chunk_a < chunk_b``.

    Rows are hashed into tiles; each unordered pair of tiles is one group that compares
    its two matrices and emits its own ``limit`` best pairs, never all of them.
    """
    rows = chunks.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
    tiles = max(1, -(-rows.count() // tile_rows))
    id_type = chunks.schema["chunk_id"].dataType
    schema = T.StructType([
        T.StructField("chunk_a", id_type), T.StructField("chunk_b", id_type),
        T.StructField("distance", T.DoubleType()),
    ])
    arrow = _arrow_schema(schema)
    mine = F.col("_t")
    placed = rows.withColumn("_t", F.pmod(F.xxhash64("chunk_id"), F.lit(tiles))).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    ).withColumn("_other", F.col("_other").cast("bigint")).withColumn("_lo", F.least(mine, "_other")).withColumn("_hi", F.greatest(mine, "_other"))

    def closest(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = np.asarray(group.column("chunk_id").to_pylist(), dtype=object)
        # Places stand for ids, as they are in the same order.
        names, place = np.unique(ids.astype(str) if isinstance(ids[0], str) else ids.astype(np.int64), return_inverse=True)
        names = names.tolist()
        side = group.column("_t").to_numpy()
        lo, hi = group.column("_lo")[0].as_py(), group.column("_hi")[0].as_py()
        best = np.zeros((3, 0))
        parts = list(_matrices(group.column("embedding")))
        for rows_a, mat_a in parts:
            for rows_b, mat_b in parts:
                pick_a, pick_b = side[rows_a] == lo, side[rows_b] == hi
                ra, rb = rows_a[pick_a], rows_b[pick_b]
                m = min(mat_a.shape[1], mat_b.shape[1])
                a, b = mat_a[pick_a][:, :m], mat_b[pick_b][:, :m]
                units, slack = _units(b), _slack(m)
                for at in range(0, len(ra) if len(rb) else 0, _SLICE):
                    mine, other = place[ra[at:at + _SLICE]], place[rb]
                    scores = _units(a[at:at + _SLICE]) @ units.T
                    if lo == hi:
                        scores[mine[:, None] >= other[None, :]] = -np.inf
                    least = np.float32(-3) if best.shape[1] < limit else np.float32(1 - best[0, -1] - 2 * slack)
                    if best.shape[1] < limit < scores.size:
                        least = max(least, np.partition(scores, scores.size - limit, axis=None)[scores.size - limit] - 2 * slack)
                    i, j = np.nonzero(scores >= least)
                    # Many copies of a vector tie, so what was found is taken in by bounded parts.
                    for x in range(0, len(i), _PAIRS):
                        p, q = i[x:x + _PAIRS], j[x:x + _PAIRS]
                        dist = np.round(1.0 - _exact(a[at:at + _SLICE], p, b, q), SCORE_DIGITS)
                        best = np.concatenate([best, [dist, np.minimum(mine[p], other[q]), np.maximum(mine[p], other[q])]], axis=1)
                        best = best[:, np.lexsort((best[2], best[1], best[0]))[:limit]]
        out = [(names[int(x)], names[int(y)], float(d)) for d, x, y in best.T]
        cols = list(zip(*out)) if out else [(), (), ()]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return (
        placed.groupBy("_lo", "_hi").applyInArrow(closest, schema)
        .orderBy("distance", "chunk_a", "chunk_b").limit(limit)
    )


def check_embeddings(chunks: DataFrame) -> DataFrame:
    """Number of chunks per vector length; fails the job on a chunk without a vector."""
    size = F.size(F.when(
        F.col("embedding").isNull(),
        F.raise_error(F.concat(F.lit("chunk has no embedding: "), F.col("chunk_id").cast("string"))),
    ).otherwise(F.col("embedding")))
    return chunks.groupBy(size.alias("dimensions")).agg(F.count(F.lit(1)).alias("total_chunks"))
