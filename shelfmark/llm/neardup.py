"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union of links.

A document's set holds its distinct ``shingle``-word sequences. SuperMinHash gives every element one random
permutation of the signature's places, drawn step by step; in step ``j`` the element offers ``j`` plus a random
fraction to its ``j``-th place, and each place keeps the least offer. A place once filled cannot be improved in a
later step, so a document is done at the first step that leaves no place empty, which for long texts is the first.

Documents with equal sets are one node. Nodes that agree in all rows of a band share a bucket. Links are found in
three rounds, the components joined after each. In the first two, one node of a bucket, its pivot, is compared with
those not yet in its component: first over a few bands, then over all of them with a pivot from the bucket's largest
component. That connects a group of thousands of near copies in a few passes over its members. In the last round
every pair of different components in one bucket is looked at, in bounded tiles, inside the tasks: pairs whose sketches
(a byte of each of ``WIDE`` places) agree too little are ruled out there, and the rest, each once, are confirmed on their full sets. Nodes
already connected need no comparison, and no pair of different components goes unseen.

With ``bands(percent, rows)`` bands a linked pair shares no bucket with a probability below 1e-7; its sketches rule it out
with a probability below 1e-6 (``DEVIATIONS``). Sets hold 64-bit hashes of shingles and are named by 128-bit hashes.

Defined results: a document without words has an empty set and is linked with nothing; one of fewer words than a
shingle has one element, all its words; rows that repeat an id are documents of their own with that id; a null
id takes part, and a component of null ids alone has a null id and is kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, recorded
from .common import Bitmap, Cached, binaries, mixed, small_batches, texts
from .components import connected_components

MISS = 1e-7
HELD = 24 << 20   # places of the permutations in memory at once
WIDE = 1024       # places of the sketch a node in a shared bucket gets
DEVIATIONS = 5    # below the mean agreement of a pair at the threshold, after which sketches rule it out
FEW = 6           # bands of the first round
TILE = 2048       # nodes of a bucket compared in one place
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands(percent: int, rows: int) -> int:
    """Bands of ``rows`` rows after which a pair at the threshold is missed with probability ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))


def shingles(text: bytes | None, k: int, ids: Cached) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word sequences of a text."""
    words = _WORD.findall((text or b"").lower())
    h = np.fromiter(map(ids.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(k, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * _STEP + h[i:len(h) - n + 1 + i]
    return np.unique(mixed(out + np.uint64(n)))


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, one row each."""
    out = np.full((len(sets), places), np.inf)
    flat = out.reshape(-1)
    h = np.concatenate(sets)
    base = np.repeat(np.arange(len(sets)) * places, [len(s) for s in sets])
    order = np.tile(np.arange(places, dtype=np.uint16), (len(h), 1))
    at = np.arange(len(h))
    for j in range(places):
        u = mixed(h + np.uint64((j + 1) * int(_STEP) & (1 << 64) - 1))
        k = j + (mixed(u) % np.uint64(places - j)).astype(np.int64)
        place = order[at, k]
        order[at, k] = order[at, j]
        np.minimum.at(flat, base + place, j + (u >> np.uint64(11)) * 2.0 ** -53)
        open_ = np.isinf(out).any(1)
        if not open_.any():
            break
        if not open_.all():
            keep = open_[base // places]
            at, h, base = at[keep], h[keep], base[keep]
    return out


def _band_keys(signature: np.ndarray, n: int, rows: int) -> np.ndarray:
    values = signature.view(np.uint64)[:, :n * rows].reshape(len(signature), n, rows)
    out = np.zeros((len(signature), n), dtype=np.uint64) + np.arange(1, n + 1, dtype=np.uint64)
    for r in range(rows):
        out = mixed(out * _STEP + values[:, :, r])
    return out


def _bytes(signature: np.ndarray) -> np.ndarray:
    return (mixed(signature.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def sketches(rows: DataFrame, k: int, n_bands: int, band_rows: int) -> DataFrame:
    """``doc_id, row_key, n_shingles, node, keys``: the set's name and its bucket in every band."""
    places = n_bands * band_rows
    held = max(1, HELD // places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Cached(xxhash.xxh64_intdigest)
        for batch in small_batches(batches, "text", 4 << 20):
            sets = [shingles(t, k, ids) for t in binaries(batch, "text")]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            keys: list = [None] * len(sets)
            group: list[int] = []

            def settle() -> None:
                if group:
                    signed = _signed([sets[i] for i in group], places, held)
                    for i, row in zip(group, _band_keys(signed, n_bands, band_rows).view(np.int64)):
                        keys[i] = row
                    group.clear()

            filled = 0
            for i in np.flatnonzero(sizes):
                if filled + sizes[i] > held:
                    settle()
                    filled = 0
                group.append(int(i))
                filled += int(sizes[i])
            settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "n_shingles", "node", "keys"])

    return rows.mapInArrow(run, "doc_id long, row_key long, n_shingles long, node binary, keys array<long>")


def _signed(sets: list[np.ndarray], places: int, held: int) -> np.ndarray:
    """Signatures; a set larger than memory allows is signed in parts whose place-wise least is its own."""
    if len(sets) == 1 and len(sets[0]) > held:
        parts = [signatures([sets[0][a:a + held]], places) for a in range(0, len(sets[0]), held)]
        return np.minimum.reduce(parts)
    return signatures(sets, places)


def _sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``id, size, items, sketch`` of the wanted nodes, hashed anew from the rows that stand for them.

    ``wanted``: ``id, doc_id, row_key``. A bitmap of fixed size keeps other texts out of the pass.
    """
    bitmap = rows.sparkSession.sparkContext.broadcast(Bitmap(wanted, "row_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Cached(xxhash.xxh64_intdigest)
        for whole in batches:
            keep = bitmap.value.passes(whole.column("row_key").to_numpy(zero_copy_only=False))
            for batch in small_batches(iter([whole.filter(pa.array(keep))]), "text"):
                sets = [shingles(t, k, ids) for t in binaries(batch, "text")]
                sketch = [_bytes(_signed([s], WIDE, HELD // WIDE))[0].tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row_key"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                     pa.array(sketch, pa.binary())], names=["doc_id", "row_key", "items", "sketch"])

    found = rows.mapInArrow(run, "doc_id long, row_key long, items array<long>, sketch binary").withColumnRenamed("doc_id", "own").withColumnRenamed("row_key", "key")
    chosen = found.join(wanted, (F.col("key") == F.col("row_key")) & F.col("own").eqNullSafe(F.col("doc_id")))
    return materialize(chosen.select("id", F.size("items").alias("size"), "items", "sketch").dropDuplicates(["id"]), "sets")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold."""
    one = sets.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("items").alias("ia"))
    two = sets.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("items").alias("ib"))
    # Sets in no pair as ``b`` stay where they are while the pairs are few.
    both = pairs.join(one, "a").join(two.join(pairs.select("b"), "b", "left_semi"), "b").withColumn("common", F.size(F.array_intersect("ia", "ib")))
    return both.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")


def _with_pivot(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """The pivot of a bucket with its other nodes, unless components or sizes rule a link out; each pair once."""
    met = members.join(pivots, "key").filter(
        (F.col("component") != F.col("pc")) & (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent))
    return met.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def _placed(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, with these."""
    placed = members.join(components, F.col("id") == F.col("node"), "left").select(
        "key", "band", "id", "n", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return materialize(placed.join(split, "key", "left_semi"), "members")


def _across(placed: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components in a bucket that sizes and sketches let through, each pair once.

    A bucket of more than ``TILE`` nodes is cut into tiles, and every two tiles meet in a place of their own.
    """
    theta = percent / 100
    share = theta + (1 - theta) / 256
    # A quarter of the sketch rules most pairs out, with one deviation to spare.
    short, least, least_short = WIDE // 4, *(
        n * share - d * math.sqrt(n * share * (1 - share)) for n, d in ((WIDE, DEVIATIONS), (WIDE // 4, DEVIATIONS + 1)))
    tiles = placed.groupBy("key").count().select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    dealt = placed.join(tiles, "key").withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "band", "id", "n", "component")
    rows = dealt.join(nodes.select("id", "keys"), "id").join(sets.select("id", "sketch"), "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs_of(rows: list) -> tuple[np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(rows)
        ids, n, component, tile = (table.column(c).to_numpy() for c in ("id", "n", "component", "tile"))
        band, two = table.column("band")[0].as_py(), table.column("i")[0].as_py() != table.column("j")[0].as_py()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        keys = np.array(table.column("keys").to_pylist(), dtype=np.int64)
        found = []
        for a in range(len(ids)):
            b = np.arange(a + 1, len(ids))
            ok = (component[b] != component[a]) & (np.minimum(n[b], n[a]) * 100 >= np.maximum(n[b], n[a]) * percent)
            b = b[ok & (tile[b] != tile[a])] if two else b[ok]
            b = b[(sketch[b, :short] == sketch[a, :short]).sum(1) >= least_short]
            b = b[(sketch[b] == sketch[a]).sum(1) >= least]
            # A pair that shares several buckets is given by the first of them.
            b = b[(keys[b, :band + 1] == keys[a, :band + 1]).argmax(1) == band]
            if len(b):
                found.append((np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.array([], np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            k = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and tuple(k[:, a]) != key:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs_of(held)], names=["a", "b"])
                    held = []
                key = tuple(k[:, a])
                held.append(batch.slice(a, b - a))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs_of(held)], names=["a", "b"])

    return rows.select("key", "i", "j", "tile", "band", "id", "n", "component", "keys", "sketch").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, band_rows: int = 6) -> DataFrame:
    """``doc_id, row_key, n_shingles, component_id, kept, chosen`` of every row.

    Rows are linked if ``100 * |intersection| >= percent * |union|``; ``component_id`` is the least id
    reachable, and a row is kept if that is its own. ``chosen`` holds for one text of each component even
    where ids repeat: the least by id and ``row_key``.
    """
    n_bands = bands(percent, band_rows)
    rows = texts(docs)
    steps: dict[str, list[str]] = {}
    with recorded() as steps["sketches"]:
        sketched = materialize(sketches(rows, shingle, n_bands, band_rows), "sketches")
    # Numbered where they are written; the numbers are read from there from then on.
    nodes = materialize(sketched.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row_key")).alias("row"), F.first("n_shingles").alias("n"),
        F.first("keys").alias("keys")).withColumn("id", F.monotonically_increasing_id()), "nodes")
    # A key holds its band, so a bucket is a key. Both columns are named throughout, so that the join takes the rows from the shuffle the groups are made of.
    every = nodes.select("id", "n", F.posexplode("keys").alias("band", "key")).repartition("key", "band")
    full = every.groupBy("key", "band").agg(F.count("*").alias("c"), F.min("id").alias("p"), F.min_by("n", "id").alias("pn")).filter("c > 1").drop("c")
    # From here on rows need no keys.
    sketched = materialize(sketched.drop("keys"), "named")
    discard(sketched.sparkSession, steps["sketches"])
    with recorded() as steps["met"]:
        met = materialize(every.join(full, ["key", "band"]), "members")
    if met.isEmpty():
        return _result(sketched, nodes.select("node", F.col("least").alias("component_id"), F.col("row").alias("first")))
    members = met.select("key", "band", "id", "n")
    wanted = nodes.join(met.select("id").distinct(), "id", "left_semi").select("id", "row.doc_id", "row.row_key")
    sets = _sets(rows, materialize(wanted, "wanted"), shingle)

    few = materialize(met.filter((F.col("band") < FEW) & (F.col("id") != F.col("p")) & (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent)).select(
        F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct(), "pairs")
    edges = materialize(_linked(few, sets, percent), "links")

    with recorded() as steps["first"]:
        placed = _placed(members, connected_components(edges))
    discard(sketched.sparkSession, steps["met"])
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("one"))
    pivots = sizes.groupBy("key").agg(F.max(F.struct("c", "component", "one")).alias("m")).select(
        "key", F.col("m.one.id").alias("p"), F.col("m.one.n").alias("pn"), F.col("m.component").alias("pc"))
    edges = edges.unionAll(materialize(_linked(materialize(_with_pivot(placed, pivots, percent), "pairs"), sets, percent), "links"))

    placed = _placed(placed.select("key", "band", "id", "n"), connected_components(edges))
    discard(sketched.sparkSession, steps["first"])
    rest = materialize(_across(placed, nodes, sets, percent), "pairs")
    edges = edges.unionAll(materialize(_linked(rest, sets, percent), "links"))

    components = connected_components(edges)
    joined = nodes.select("id", "least", "row").join(components, F.col("id") == F.col("node")).drop("node")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.min("row").alias("first"))
    known = joined.select("id", "component").join(least, "component").select("id", "component_id", "first")
    return _result(sketched, nodes.select("id", "node", "least", "row").join(known, "id", "left").select(
        "node", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("first", "row").alias("first")))


def _result(sketched: DataFrame, of_node: DataFrame) -> DataFrame:
    return sketched.select("doc_id", "row_key", "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id", "row_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.struct("doc_id", "row_key") == F.col("first"), F.lit(True)).alias("chosen")).withColumn(
            "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
