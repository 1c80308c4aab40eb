"""Helpers the pipeline operators share.

Conventions that hold for every operator here, unless its docstring says otherwise:

* Only the columns an operator names are read, so further columns of any name do not matter.
* A row is an input row: repeated rows each get their own result row, equal to one another.
* A null text counts as an empty one. A null id is a value like any other.
* An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)


def texts(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """``name`` as long, ``text`` (null: empty) and ``row_key``, equal for equal rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.col(name).cast("long").alias(name), text.alias("text")).withColumn(
        "row_key", F.xxhash64(name, "text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows named by ``doc_id, row_key`` as :func:`texts` gives them.

    A bitmap of their keys leaves the texts of other rows where they are; what passes it meets the rows themselves. ``docs``
    is read twice, so it has to be the same each time.
    """
    key, mine, other = (unused(docs, n) for n in ("row_key", "mine", "other"))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    named = rows.select(F.col("doc_id").alias(mine), F.col("row_key").alias(other)).distinct()
    bitmap = docs.sparkSession.sparkContext.broadcast(Bitmap(named, other))

    @F.pandas_udf("boolean")
    def passes(keys: pd.Series) -> pd.Series:
        return pd.Series(bitmap.value.passes(keys.to_numpy()))

    same = (F.col(key) == F.col(other)) & F.col("doc_id").cast("long").eqNullSafe(F.col(mine))
    left = keyed.filter(~passes(key)).unionAll(keyed.filter(passes(key)).join(named, same, "left_anti"))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def remainder(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def share(column: Column) -> Column:
    """A number in [0, 1) that depends only on the value, for samples that do not depend on partitioning."""
    return (F.xxhash64(column, F.lit("sample")).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that their order and high bits look random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def binaries(batch: pa.RecordBatch, name: str) -> list:
    """The values of a text column as UTF-8 bytes."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


# What an operator keeps in a Python worker from task to task, by the operator's name.
KEPT: dict[str, dict] = {}


def small_batches(batches: Iterator[pa.RecordBatch], name: str, limit: int = 8 << 20, keeps: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts take about ``limit`` bytes, one row at least.

    Lets go what other operators than ``keeps`` have left in this worker.
    """
    for other in [k for k in KEPT if k != keeps]:
        del KEPT[other]
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Cached(dict):
    """A function's values by argument. It holds ``limit`` of them at most, those not used for longest going first:
    when half of them are new, the older half that was not asked for since then is let go."""

    def __init__(self, function, limit: int = 1 << 20):
        super().__init__()
        self.function, self.half, self.older = function, limit // 2, {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        self[key] = value
        return value


class Frequent(Cached):
    """A cache that takes in an argument when it comes for the second time, so those that come once take no room.

    What has come is remembered in a table of fixed size, begun anew when it fills up.
    """

    SEEN = 1 << 23

    def __init__(self, function, limit: int = 1 << 20, together=None):
        super().__init__(function, limit)
        self.seen, self.marks, self.together = bytearray(self.SEEN), 0, together

    def __missing__(self, key):
        return super().__missing__(key) if self._comes_again(key) else self.function(key)

    def _comes_again(self, key) -> bool:
        at = hash(key) % self.SEEN
        if self.seen[at]:
            return True
        if self.marks > self.SEEN // 2:
            self.seen, self.marks = bytearray(self.SEEN), 0
        self.seen[at] = 1
        self.marks += 1
        return False

    def values_of(self, keys: set) -> dict:
        """The values of distinct arguments; what is not held is worked out by one call of ``together``."""
        found, missing, held = {}, [], self.get
        for key in keys:
            value = held(key)
            if value is None:
                missing.append(key)
            else:
                found[key] = value
        older, new = self.older, []
        for key in missing:
            value = older.get(key)
            if value is None:
                new.append(key)
            else:
                found[key] = value
                self._take(key, value)
        for key, value in zip(new, self.together(new)):
            found[key] = value
            if self._comes_again(key):
                self._take(key, value)
        return found

    def _take(self, key, value) -> None:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value


class IntTable:
    """Rows of values by 64-bit key, looked up for whole arrays (open addressing)."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, self.EMPTY, dtype=np.uint64)
        self.values = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
        self.at = np.full(1 << bits, len(keys), dtype=np.int32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.slots[slot] == self.EMPTY
            _, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.slots[slot[chosen]], self.at[slot[chosen]] = keys[left[chosen]], left[chosen]
            rest = np.ones(len(left), dtype=bool)
            rest[chosen] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of every key; the number of rows for a key that is absent."""
        slot = self.slot(keys)
        held = self.slots[slot]
        out = self.at[slot]
        odd = np.flatnonzero((held != keys) & (held != self.EMPTY))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & self.mask
            held = self.slots[slot[odd]]
            out[odd] = self.at[slot[odd]]
            odd = odd[(held != keys[odd]) & (held != self.EMPTY)]
        return out


class Bitmap:
    """A set of 64-bit hashes in a bitmap of fixed size: it never misses one, and lets a few others through.

    What reaches the driver and is broadcast is bounded by the bitmap, whatever is put in; the
    more there is, the more passes, so it only ever saves work in front of an exact join.
    """

    BITS = 26  # 8 MB

    def __init__(self, hashes: DataFrame, name: str):
        at = F.shiftrightunsigned(name, 64 - self.BITS)
        rows = hashes.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(
            F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
        self.words = np.zeros(1 << (self.BITS - 6), dtype=np.uint64)
        self.words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(64 - self.BITS)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
