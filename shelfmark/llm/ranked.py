"""Ranked lexical search over a term-partitioned index, item bundles passing from owner to owner.

Documents are dealt to shards of bounded size where they are read. Their terms become postings, packed per shard and term,
and every term has one owner: the stage of its document frequency, so that rare and heavy terms are met first.
Items start with empty bundles. A stage cogroups the bundles of a shard with its owner's postings there and adds integer
contributions to the sparse document accumulators a bundle carries; the bundle goes on to the next owner. After the last
one the best documents of each shard are left, of which the best of all are taken.

No accumulator is dropped that could still matter: the ``k``-th best partial score of an item, over the shard
and (between stages) over all shards, only grows, and what the owners ahead can add at most is known. A document that
cannot reach that score with it leaves the bundle, and once all owners ahead together cannot reach it, only documents
already in the bundle are added to. Documents that could end equal to it stay.

Only terms that items ask for are indexed; a bitmap of fixed size keeps the others out before the exact join. Items are
searched in blocks of bounded size, shards hold ``SHARD_DOCS`` documents or ``SHARD_BYTES`` of text (one document at least), so
a group of a cogroup is bounded whatever the corpus, and a term that every document holds is spread over all shards.

Defined results: null and empty texts have no terms; items without terms, or whose terms no document holds, have no
results; items that repeat are items of their own; documents that repeat an id are ranked each, a null id after the others
of its score; a score of 0 is none; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import Bitmap, binaries, small_batches

SHARD_DOCS = 1024
SHARD_BYTES = 8 << 20
BLOCK_ITEMS = 512
BLOCK_TERMS = 1 << 19
OWNERS = (0.001, 0.01, 0.1)   # shares of the documents up to which a term belongs to an owner; the last owner has the rest
HEADS = -1                    # stands for an owner where the shards' documents are kept
TOP = 20
UNIT = 1_000_000              # no document gets as much per unit of weight
PIECE = 1 << 20

WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def words(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of those of about ``PIECE`` bytes."""
    text = text or b""
    start = 0
    while start < len(text):
        gap = _BETWEEN.search(text, start + PIECE) if start + PIECE < len(text) else None
        stop = gap.start() if gap else len(text)
        yield WORDS.findall(text[start:stop].lower())
        start = stop


def signed_hash(word: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(word)).astype(np.int64))


def item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, term, times, hash`` of every item row, numbered by ``item``; written once, as numbers must stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            for item, item_id, text in zip(batch.column("item").to_pylist(), batch.column("item_id").to_pylist(), binaries(batch, "text")):
                counts: Counter = Counter()
                for piece in words(text):
                    counts.update(piece)
                terms = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(terms), pa.int64()), pa.array([item_id] * len(terms), pa.int64()), pa.array(terms, pa.binary()),
                     pa.array([counts[t] for t in terms], pa.int64()), pa.array(map(signed_hash, terms), pa.int64())],
                    names=["item", "item_id", "term", "times", "hash"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(rows.withColumn("item", F.monotonically_increasing_id()).mapInArrow(
        run, "item long, item_id long, term binary, times long, hash long"), "items")


POSTINGS = "shard long, term binary, docs binary, tfs binary, ids array<long>, lengths array<long>"


class _Codes:
    """Numbers for the words of a shard that may be asked for, -1 for the others."""

    def __init__(self, asked: Bitmap):
        self.asked, self.names, self.known = asked, [], {}

    def of(self, words_: list[bytes]) -> np.ndarray:
        new = list(set(words_).difference(self.known))
        if new:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, new), dtype=np.uint64, count=len(new))
            held = self.asked.passes(hashes)
            self.known.update(dict.fromkeys(new, -1))
            for at in np.flatnonzero(held).tolist():
                self.known[new[at]] = len(self.names)
                self.names.append(new[at])
        return np.fromiter(map(self.known.__getitem__, words_), dtype=np.int64, count=len(words_))


def postings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Packed postings of the words whose ``hash`` is in ``asked`` (and a few others), per shard and term.

    A shard has one row without a term, with the ids and lengths of its documents; postings name them by place.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(Bitmap(asked, "hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for whole in small_batches(batches, "text", SHARD_BYTES):
            for a in range(0, whole.num_rows, SHARD_DOCS):
                yield _packed(whole.slice(a, SHARD_DOCS), shard, _Codes(bitmap.value))
                shard += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(run, POSTINGS), "postings")


def _packed(batch: pa.RecordBatch, shard: int, codes: _Codes) -> pa.RecordBatch:
    lengths, keys = np.zeros(batch.num_rows, dtype=np.int64), [np.zeros(0, dtype=np.int64)]
    for at, text in enumerate(binaries(batch, "text")):
        for piece in words(text):
            lengths[at] += len(piece)
            found = codes.of(piece)
            keys.append((found[found >= 0] << 32) + at)
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    code, doc = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
    edges = [*np.flatnonzero(np.diff(code, prepend=-1)).tolist(), len(code)]
    own = [codes.names[code[a]] for a in edges[:-1]]
    packed = lambda x: [x[a:b].tobytes() for a, b in zip(edges, edges[1:])]
    n, none = len(own), [None] * len(own)
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * (n + 1), pa.int64()), pa.array([None, *own], pa.binary()), pa.array([None, *packed(doc)], pa.binary()),
         pa.array([None, *packed(times.astype(np.int64))], pa.binary()),
         pa.array([batch.column("doc_id").to_pylist(), *none], pa.list_(pa.int64())), pa.array([lengths, *none], pa.list_(pa.int64()))],
        names=["shard", "term", "docs", "tfs", "ids", "lengths"])


@dataclass(frozen=True)
class Corpus:
    """Documents with terms, and all their terms with repeats."""

    documents: int
    terms: int

    def length_part(self, lengths: np.ndarray) -> np.ndarray:
        return 75 + 25 * lengths * self.documents // self.terms


@dataclass(frozen=True)
class Block:
    """Items searched together: for each owner its terms with the places and weights of the items that ask for them."""

    items: np.ndarray
    asked: list[dict[bytes, tuple[np.ndarray, np.ndarray]]]
    bounds: np.ndarray     # owner, item: the most this owner and those after it can add

    @classmethod
    def of(cls, rows: pa.Table, owners: int) -> "Block":
        items, place = np.unique(rows["item"].to_numpy(), return_inverse=True)
        weight, owner = rows["weight"].to_numpy() * rows["times"].to_numpy(), rows["owner"].to_numpy()
        bounds = np.zeros((owners + 1, len(items)), dtype=np.int64)
        np.add.at(bounds, (owner, place), weight * UNIT)
        asked: list[dict] = [{} for _ in range(owners)]
        terms, order = rows["term"].to_pylist(), np.argsort(owner, kind="stable")
        for r in order.tolist():
            asked[owner[r]].setdefault(terms[r], []).append((place[r], weight[r]))
        packed = [{t: tuple(np.array(x, dtype=np.int64) for x in zip(*pairs)) for t, pairs in own.items()} for own in asked]
        return cls(items, packed, bounds[::-1].cumsum(0)[::-1])


BUNDLES = "shard long, item long, docs binary, scores binary, top array<long>, best array<struct<doc_id:long,score:long>>"
_BEST = pa.list_(pa.struct([("doc_id", pa.int64()), ("score", pa.int64())]))
_BUNDLE_SCHEMA = pa.schema([("shard", pa.int64()), ("item", pa.int64()), ("docs", pa.binary()), ("scores", pa.binary()),
                            ("top", pa.list_(pa.int64())), ("best", _BEST)])


def contributions(tfs: np.ndarray, length_part: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tfs // (1000 * tfs + 12 * length_part)


def _stage(bundles: pa.Table, index: pa.Table, block: Block, owner: int, floors: np.ndarray, corpus: Corpus, k: int) -> pa.Table:
    """One owner's additions to the bundles of one shard."""
    terms = index["term"].to_pylist()
    head = terms.index(None)
    ids, lengths = index["ids"][head].as_py(), np.array(index["lengths"][head].as_py(), dtype=np.int64)
    part = corpus.length_part(lengths)
    scores = np.zeros((len(block.items), len(part)), dtype=np.int64)
    for item, docs, held in zip(bundles["item"].to_pylist(), bundles["docs"].to_pylist(), bundles["scores"].to_pylist()):
        scores[np.searchsorted(block.items, item), np.frombuffer(docs, np.int32)] = np.frombuffer(held, np.int64)
    carried = scores > 0
    # From here on an item whose owners cannot reach its floor by themselves takes in no further documents.
    closed = block.bounds[owner] < floors
    for term, docs, tfs in zip(terms, index["docs"].to_pylist(), index["tfs"].to_pylist()):
        asking = block.asked[owner].get(term) if term is not None else None
        if asking is None:
            continue
        at = np.frombuffer(docs, np.int32)
        add = contributions(np.frombuffer(tfs, np.int64), part[at])
        for place, weight in zip(*(x.tolist() for x in asking)):
            if closed[place]:
                keep = carried[place, at]
                scores[place, at[keep]] += weight * add[keep]
            else:
                scores[place, at] += weight * add
    ahead, last = block.bounds[owner + 1], owner + 1 == len(block.asked)
    out: list[tuple] = []
    for place in np.flatnonzero(scores.any(1)).tolist():
        docs = np.flatnonzero(scores[place])
        own = scores[place, docs]
        top = np.sort(own)[::-1][:k]
        floor = max(int(floors[place]), int(top[-1]) if len(top) == k else 0)
        keep = own + ahead[place] >= floor
        docs, own, item = docs[keep].astype(np.int32), own[keep], int(block.items[place])
        if last:
            ranked = sorted(((-s, ids[d] is None, ids[d] or 0, ids[d]) for d, s in zip(docs.tolist(), own.tolist())), key=lambda r: r[:3])[:k]
            out.append((item, None, None, None, [{"doc_id": r[3], "score": -r[0]} for r in ranked]))
        elif len(docs):
            out.append((item, docs.tobytes(), own.tobytes(), top.tolist(), None))
    columns = list(zip(*out)) or [()] * 5
    shard = index["shard"][0].as_py()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(([shard] * len(out), *columns), _BUNDLE_SCHEMA)], schema=_BUNDLE_SCHEMA)


def _floors(bundles: DataFrame, items: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th best partial score of every item over all shards, 0 where there are fewer."""
    best = Window.partitionBy("item").orderBy(F.desc("v"))
    ranked = bundles.select("item", F.explode("top").alias("v")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    rows = ranked.filter(F.col("r") == k).select("item", "v").toArrow()
    floors = np.zeros(len(items), dtype=np.int64)
    floors[np.searchsorted(items, rows["item"].to_numpy())] = rows["v"].to_numpy()
    return floors


def _visit(shared, owner: int, corpus: Corpus, k: int):
    def run(bundles: pa.Table, index: pa.Table) -> pa.Table:
        block, floors = shared.value
        return _stage(bundles, index, block, owner, floors, corpus, k)

    return run


def _search_block(index: DataFrame, block: Block, corpus: Corpus, k: int) -> DataFrame:
    """``item, doc_id, score``: the best of every shard."""
    spark = index.sparkSession
    bundles = spark.createDataFrame([], BUNDLES)
    floors = np.zeros(len(block.items), dtype=np.int64)
    for owner in range(len(block.asked)):
        run = _visit(spark.sparkContext.broadcast((block, floors)), owner, corpus, k)
        owned = index.filter(F.col("owner").isin(owner, HEADS)).drop("owner")
        step = bundles.groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(run, BUNDLES)
        bundles = materialize(step, "bundles")
        if owner + 1 < len(block.asked):
            floors = _floors(bundles, block.items, k)
    return bundles.select("item", F.explode("best").alias("b")).select("item", "b.doc_id", "b.score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, owners: tuple[float, ...] = OWNERS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents (``doc_id, text``) of every item (``item_id, text``)."""
    spark = docs.sparkSession
    pairs = item_terms(items)
    raw = postings(docs, pairs.select("hash"))
    heads = raw.filter("term IS NULL").agg(
        F.sum(F.size(F.filter("lengths", lambda n: n > 0))).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)).alias("l")).first()
    corpus = Corpus(heads["n"] or 0, heads["l"] or 0)
    schema = "item_id long, rank int, doc_id long, score long"
    if not corpus.documents:
        return spark.createDataFrame([], schema)
    n = corpus.documents
    asked = pairs.select("term").distinct()
    df = raw.filter("term IS NOT NULL").groupBy("term").agg(F.sum(F.octet_length("docs") / 4).cast("long").alias("df")).join(asked, "term")
    owner = sum((F.when(F.col("df") > share * n, 1).otherwise(0) for share in owners), F.lit(0))
    terms = materialize(df.select("term", owner.alias("owner"), F.floor(F.log(F.lit(2.0 * n + 2.0) / (F.col("df") * 2.0 + 1.0)) * 1000).alias("weight")), "terms")
    # One folder per owner, and one for the shards' documents.
    indexed = raw.join(terms.select("term", "owner"), "term", "left").filter("term IS NULL OR owner IS NOT NULL")
    index = materialize(indexed.select("shard", "term", "docs", "tfs", "ids", "lengths", F.coalesce("owner", F.lit(HEADS)).alias("owner")), "index", "owner")

    weighted = materialize(pairs.join(terms, "term").select("item", "term", "times", "owner", "weight"), "weighted")
    size = weighted.agg(F.count_distinct("item").alias("items"), F.count("*").alias("terms")).first()
    blocks = max(1, -(-size["items"] // BLOCK_ITEMS), -(-size["terms"] // BLOCK_TERMS))
    found = None
    for number in range(blocks):
        rows = weighted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).toArrow()
        if rows.num_rows:
            part = _search_block(index, Block.of(rows, len(owners) + 1), corpus, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = pairs.select("item", "item_id").distinct()
    return ranked.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
