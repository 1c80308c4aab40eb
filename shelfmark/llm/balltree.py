"""Exact top-k inner products by ball-tree branch and bound.

Vectors are dealt into shards; each shard keeps a ball tree as one row of arrays (vectors in leaf order, and for
each node its centre, radius and range). Queries go through the shards in blocks of a fixed size. The first pass
scores each query's most promising leaf of every shard; the best k-th score found anywhere is a lower bound that
all shards share in the second pass. There a node is opened only if its bound, <q, centre> + radius * |q|, reaches the
k-th score so far; leaves are taken in order of their bound. Each shard gives its k best at most, and a top-k over
shards gives the result.

Scores are exact: integers below 2**53 in size are multiplied as doubles, larger ones as Python integers.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, as queries or
candidates, nor do rows without an id; a query meets only vectors of its own length; rows with the query's own id are not its candidates;
repeated rows are candidates each by itself; a score beyond a long becomes the nearest one, and a repeated query id gets the result of each of its rows' vectors,
distinct ones numbered by ``variant``; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_dir, materialize

SHARD_ROWS = 8192
LEAF = 64
BLOCK = 2048  # queries in memory at once
SAFE = float(1 << 53)
LONG = (1 << 63) - 1


def integral(column: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component as a double; null where the vector takes no part."""
    values = F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(column.isNotNull() & (F.size(column) > 0) & finite, values)


def grow(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A ball tree: nodes in breadth-first order, each the range ``lo:hi`` of the reordered rows."""
    order = np.lexsort((ids,))
    lo, hi, left = [0], [len(ids)], []
    centres, radii = [], []
    at = 0
    while at < len(lo):
        a, b = lo[at], hi[at]
        rows = x[order[a:b]]
        centre = rows.mean(0)
        far = np.sqrt(((rows - centre) ** 2).sum(1))
        centres.append(centre)
        # A hair more than the radius, for what rounding may take away.
        radii.append(float(far.max()) * (1 + 1e-9) + 1e-6)
        if b - a > leaf and far.max() > 0:
            one = rows[far.argmax()]
            two = rows[((rows - one) ** 2).sum(1).argmax()]
            side = np.argsort(rows @ (two - one), kind="stable")
            order[a:b] = order[a:b][side]
            middle = a + (b - a) // 2
            left.append(len(lo))
            lo += [a, middle]
            hi += [middle, b]
        else:
            left.append(-1)
        at += 1
    return {"ids": ids[order], "x": x[order], "lo": np.array(lo), "hi": np.array(hi), "left": np.array(left),
            "centre": np.array(centres), "radius": np.array(radii)}


def _pack(tree: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **tree)
    return out.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as held:
        return {k: held[k] for k in held.files}


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows."""
    size = x.shape[1] * max(1.0, float(np.abs(x).max(initial=0))) * max(1.0, float(np.abs(q).max(initial=0)))
    if size < SAFE:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(q) @ whole(x).T


def _below(score: int) -> float:
    """A double that is not above an integer score."""
    return float(score) if abs(score) < SAFE else float(np.nextafter(float(score), -np.inf))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """Write the shards of ``vec_id, v`` (either null: left out) to the shared folder; one row per shard and length."""
    valid = vectors.filter("v IS NOT NULL AND vec_id IS NOT NULL")
    n = max(1, -(-valid.count() // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                held.setdefault(len(v), []).append((i, v))
        for dim, rows in sorted(held.items()):
            tree = grow(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float), leaf)
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([_pack(tree)], pa.binary())], names=["dim", "tree"])

    dealt = valid.repartition(n, F.xxhash64("vec_id", "v"))
    return materialize(dealt.select("vec_id", "v").mapInArrow(run, "dim int, tree binary"), "balls")


def _bounds(tree: dict, nodes: np.ndarray, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bound of every (query, node) pair given as parallel arrays."""
    dot = np.einsum("ij,ij->i", q, tree["centre"][nodes])
    return dot + tree["radius"][nodes] * norm + 1e-6 * (1 + np.abs(dot))


def _leaves(tree: dict, q: np.ndarray, norm: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leaves a query must see, as (query, node, bound), best bound first for each query."""
    rows, nodes = np.arange(len(q)), np.zeros(len(q), dtype=np.int64)
    bound = _bounds(tree, nodes, q, norm)
    done = []
    while len(rows):
        keep = bound >= floor[rows]
        rows, nodes, bound = rows[keep], nodes[keep], bound[keep]
        leaf = tree["left"][nodes] < 0
        done.append((rows[leaf], nodes[leaf], bound[leaf]))
        rows, nodes = rows[~leaf], nodes[~leaf]
        rows, nodes = np.concatenate([rows, rows]), np.concatenate([tree["left"][nodes], tree["left"][nodes] + 1])
        bound = _bounds(tree, nodes, q[rows], norm[rows])
    rows, nodes, bound = (np.concatenate(x) for x in zip(*done))
    order = np.lexsort((nodes, -bound, rows))
    return rows[order], nodes[order], bound[order]


def branch_and_bound(tree: dict, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, first_only: bool = False):
    """Per query the best ``k`` (score, id) pairs of one shard that reach ``floor``; ties to the smaller id."""
    norm = np.sqrt((q * q).sum(1))
    rows, nodes, bound = _leaves(tree, q, norm, floor)
    best: list[list[tuple]] = [[] for _ in range(len(q))]
    kth = floor.astype(float).copy()
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.array([], dtype=int)
    turn = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    for r in range(1 if first_only else int(turn.max(initial=-1)) + 1):
        at = np.flatnonzero(turn == r)
        at = at[bound[at] >= kth[rows[at]]]
        if not len(at):
            break
        for node in np.unique(nodes[at]):
            mine = rows[at[nodes[at] == node]]
            a, b = tree["lo"][node], tree["hi"][node]
            scores = _product(q[mine], tree["x"][a:b])
            own = tree["ids"][a:b]
            for i, row in enumerate(mine):
                ok = np.flatnonzero((own != ids[row]) & (scores[i] >= kth[row]))
                if not len(ok):
                    continue
                merged = best[row] + [(-int(s), int(v)) for s, v in zip(scores[i][ok], own[ok])]
                merged.sort()
                best[row] = merged[:k]
                if len(best[row]) == k:
                    kth[row] = max(kth[row], _below(-best[row][-1][0]))
    return best


def search(index: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``query_id, variant, rank, vec_id, score``: the ``k`` best of ``index`` for every ``query_id, v``.

    Only one block of queries is on the driver at a time, and it is as large as ``block`` whatever the table.
    """
    spark = index.sparkSession
    valid = queries.filter("v IS NOT NULL AND query_id IS NOT NULL").select("query_id", "v").distinct()
    w = Window.partitionBy("query_id").orderBy("v")
    valid = valid.withColumn("variant", F.row_number().over(w).cast("int"))
    n = valid.count()
    blocks = max(1, -(-n // (block // 2)))  # half full on average, so that chance does not overfill one
    dealt = materialize(valid.withColumn("block", F.pmod(F.xxhash64("query_id", "variant"), F.lit(blocks)).cast("int")).repartition(
        min(blocks, 4096), "block"), "queries")
    out = fresh_dir(spark, "neighbours")
    schema = "query_id long, variant int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for b in range(blocks if n else 0):
        rows = sorted(dealt.filter(F.col("block") == b).select("query_id", "variant", "v").collect())
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r["v"]), []).append(r)
        packed = {d: (np.array([r["query_id"] for r in rs], dtype=np.int64), np.array([r["variant"] for r in rs], dtype=np.int32),
                      np.array([r["v"] for r in rs], dtype=float)) for d, rs in by_dim.items()}
        if packed:
            _block(index, spark.sparkContext.broadcast(packed), k).write.mode("append").parquet(out)
    found = spark.read.schema(schema).parquet(out)
    order = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "variant", F.col("rank").cast("int"), "vec_id", "score")


def _block(index: DataFrame, packed, k: int) -> DataFrame:
    """Hits of one block of queries in all shards, after they have shared a lower bound."""
    spark = index.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, blob in zip(batch.column("dim").to_pylist(), batch.column("tree").to_pylist()):
                if dim in packed.value:
                    ids, _, q = packed.value[dim]
                    best = branch_and_bound(_unpack(blob), ids, q, k, np.full(len(q), -np.inf), first_only=True)
                    full = [i for i, x in enumerate(best) if len(x) == k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim] * len(full), pa.int32()), pa.array(full, pa.int32()),
                         pa.array([_below(-best[i][-1][0]) for i in full], pa.float64())], names=["dim", "i", "kth"])

    shared = index.mapInArrow(first, "dim int, i int, kth double").groupBy("dim", "i").agg(F.max("kth").alias("kth")).collect()
    floors = {d: np.full(len(x[0]), -np.inf) for d, x in packed.value.items()}
    for r in shared:
        floors[r["dim"]][r["i"]] = r["kth"]
    bounds = spark.sparkContext.broadcast(floors)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, blob in zip(batch.column("dim").to_pylist(), batch.column("tree").to_pylist()):
                if dim in packed.value:
                    ids, variants, q = packed.value[dim]
                    best = branch_and_bound(_unpack(blob), ids, q, k, bounds.value[dim])
                    hits = [(int(ids[i]), int(variants[i]), v, max(-LONG - 1, min(LONG, -s))) for i, x in enumerate(best) for s, v in x]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*hits) if hits else ([],) * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                        names=["query_id", "variant", "vec_id", "score"])

    return index.mapInArrow(second, "query_id long, variant int, vec_id long, score long")
