"""Benchmark decontamination by winnowed fingerprints.

Words are lower-cased runs (A-Z only) of digits, letters and non-ASCII characters. A window is ``width``
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Each window is
named by the least hash of its ``gram``-word pieces: the fingerprint winnowing keeps for it. Two texts that share
a window therefore share its fingerprint, so every shared span of ``width`` words or more is met.

Documents are fingerprinted in one narrow pass. A bitmap of the benchmark's fingerprints, of a fixed size
whatever the benchmark's, drops the windows that cannot match; the rest are joined with the benchmark on the
fingerprint and the window's words, which confirms them exactly, and hits are extended to the union of windows.

Defined results: a null or empty text has no words, no hits and is clean; items with null ids, without words or
null text take no part; items with one id count once; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Bitmap, Cached, binaries, mixed, small_batches, texts

WIDTH = 10
GRAM = 5

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MARKS = "array<struct<print:bigint,start:int,length:int,words:binary>>"


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        out = out * _STEP + h[i:i + n]
    return mixed(out + np.uint64(k))


def _prints(h: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The fingerprint of every window of ``width`` words: the least hash among its grams."""
    gram = min(gram, width)
    g = _grams(h, gram)
    n = len(h) - width + 1
    out = g[:max(0, n)].copy()
    for i in range(1, width - gram + 1 if n > 0 else 0):
        np.minimum(out, g[i:i + n], out=out)
    return mixed(out + np.uint64(width))


def _marked(texts_: list, ids: Cached, widths: list[int], gram: int, bitmap: Bitmap | None, whole: int | None):
    """Word counts and the windows a bitmap lets through (all, if there is none).

    ``whole``: a text of fewer words is one window of its own.
    """
    counts, marks = [], []
    for text in texts_:
        words = WORDS.findall((text or b"").lower())
        counts.append(len(words))
        h = np.fromiter(map(ids.__getitem__, words), dtype=np.uint64, count=len(words))
        row = []
        own = [min(whole, len(words))] if whole and words else [] if whole else widths
        for width in own:
            prints = _prints(h, width, gram)
            if bitmap is None:
                keep = range(len(prints))
            else:
                keep = np.flatnonzero(bitmap.passes(prints)).tolist()
            signed = prints.view(np.int64)
            row += [{"print": int(signed[s]), "start": s, "length": width, "words": b" ".join(words[s:s + width])} for s in keep]
        marks.append(row)
    return counts, marks


def fingerprints(rows: DataFrame, id_name: str, widths: list[int], gram: int, bitmap=None, whole: int | None = None) -> DataFrame:
    """``id, row_key, n_words, marks`` of every row, by one narrow pass over whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap is not None else None
        ids = Cached(xxhash.xxh64_intdigest)
        for batch in small_batches(batches, "text"):
            counts, marks = _marked(binaries(batch, "text"), ids, widths, gram, bits, whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_name), batch.column("row_key"), pa.array(counts, pa.int64()), pa.array(marks, _ARROW)],
                names=[id_name, "row_key", "n_words", "marks"])

    return rows.mapInArrow(run, f"{id_name} long, row_key long, n_words long, marks {_MARKS}")


_ARROW = pa.list_(pa.struct([("print", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("words", pa.binary())]))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document row: ``doc_id, row_key, n_words, n_hit, items`` (sorted ids, as text) and ``spans`` of hit words.

    The items of a window are gathered once and sorted, so a passage many documents share adds one row per
    document and window, and a document gathers one copy of the items its windows have in common.
    """
    spark = docs.sparkSession
    rows = texts(items.select(F.col("item_id").alias("doc_id"), "text"))
    windows = materialize(
        fingerprints(rows.filter("doc_id IS NOT NULL"), "doc_id", [], gram, whole=width)
        .select("doc_id", F.explode("marks").alias("m")).select("doc_id", "m.print", "m.length", "m.words")
        .groupBy("print", "length", "words").agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("items")), "windows")
    widths = sorted({width, *(r[0] for r in windows.select("length").distinct().collect())})
    bitmap = spark.sparkContext.broadcast(Bitmap(windows, "print"))
    marked = materialize(fingerprints(texts(docs), "doc_id", widths, gram, bitmap), "marks")
    hits = marked.filter(F.size("marks") > 0).select("doc_id", "row_key", F.explode("marks").alias("m")).select(
        "doc_id", "row_key", "m.print", "m.start", "m.length", "m.words").join(
            windows, ["print", "length", "words"])
    spans = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    merged = hits.groupBy("doc_id", "row_key").agg(spans.alias("windows"), F.collect_set("items").alias("sets"))
    found = merged.select(
        F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"),
        # A window starts a new span where it does not touch what lies before it.
        F.aggregate("windows", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, w: F.struct(
            F.greatest(a["end"], w["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), w["end"] - F.greatest(a["end"], w["start"]))).alias("n")))["n"].alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"), "windows")
    return marked.join(found, (F.col("row_key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("windows", F.array().cast("array<struct<start:int,end:int>>")).alias("windows"))
