"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes. A byte's probability under the longest
context seen is its share there, with an escape to the next shorter context whose weight is the number of distinct
bytes that followed (method C, without exclusion); the empty context escapes to all bytes alike. The sum of
code lengths, -log2 p, over a text's bytes, lower-cased, under frozen counts, is exact. The
language with the shortest code wins, and the score is its share of the posterior under equal priors.

The trees are fitted on slices of training texts, chosen by a hash, of ``TRAIN_BYTES`` bytes per language in
expectation. Their counts are summed on Spark; the model's size is bounded by that sample, so it is broadcast.

Defined results: a null text, one without a letter, or a corpus without languages to learn gives ``und`` with
score 0; a null language does not train; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IntTable, remainder, small_batches, texts

ORDER = 4
TRAIN_BYTES = 1_500_000
SLICE = 2048


def _keys(data: np.ndarray, order: int) -> np.ndarray:
    """Every byte with the ``order`` before it as one integer; the text is preceded by line feeds."""
    padded = np.concatenate([np.full(order, 10, np.uint8), data]).astype(np.uint64)
    out = np.zeros(len(data), dtype=np.uint64)
    for i in range(order + 1):
        out = (out << np.uint64(8)) | padded[i:i + len(data)]
    return out


def _lowered(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)


def counted(docs: DataFrame, order: int = ORDER, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``lang, gram, n``: (order + 1)-byte sequences in the sampled slices of ``doc_id, text, lang``."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    limit = {k: int(min(1.0, train_bytes / max(1, n)) * ((1 << 64) - 1)) for k, n in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            taken: dict[str, list[np.ndarray]] = {}
            for doc, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                chosen = [i for i in range(0, len(text), SLICE)
                          if xxhash.xxh64_intdigest(f"{doc}:{i}") <= limit[lang]]
                for i in chosen:
                    taken.setdefault(lang, []).append(_keys(_lowered(text[max(0, i - order):i + SLICE]), order)[min(i, order):])
            for lang, found in taken.items():
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen code lengths, in bits, of every language at once."""

    def __init__(self, languages: list[str], grams: np.ndarray, langs: np.ndarray, n: np.ndarray, order: int = ORDER):
        self.languages, self.order = languages, order
        width = len(languages)
        self.codes: list[IntTable] = []   # by order: rows of code lengths by (context, byte)
        self.escapes: list[IntTable] = []  # by order: rows of escape lengths by context
        for k in range(order + 1):
            keep = np.uint64((1 << (8 * (k + 1))) - 1)
            keys, at = np.unique(grams.view(np.uint64) & keep, return_inverse=True)
            counts = np.zeros((len(keys), width))
            np.add.at(counts, (at, langs), n)
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, of, counts)
            np.add.at(kinds, of, counts > 0)
            seen = total > 0
            # A context that was never seen passes on without a cost.
            escape = np.where(seen, -np.log2(np.where(seen, kinds, 1) / np.where(seen, total + kinds, 1)), 0.0)
            self.escapes.append(IntTable(contexts, escape.astype(np.float32)))
            lower = self.lengths(keys & np.uint64((1 << (8 * k)) - 1), k - 1) if k else np.full((len(keys), width), 8.0)
            direct = counts > 0
            own = -np.log2(np.where(direct, counts, 1) / (total + kinds)[of].clip(1))
            self.codes.append(IntTable(keys, np.where(direct, own, escape[of] + lower).astype(np.float32)))

    def lengths(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths by language of (context, byte) keys of one order."""
        table = self.codes[order]
        found = table.find(keys)
        out = table.values[found].astype(np.float64)
        odd = np.flatnonzero(found == len(table.values) - 1)
        if len(odd):
            rest, inverse = np.unique(keys[odd], return_inverse=True)
            escapes = self.escapes[order]
            cost = escapes.values[escapes.find(rest >> np.uint64(8))].astype(np.float64)
            cost += self.lengths(rest & np.uint64((1 << (8 * order)) - 1), order - 1) if order else 8.0
            out[odd] = cost[inverse]
        return out

    def bits(self, batch: list[str]) -> np.ndarray:
        """Code length of every text under every language."""
        out = np.zeros((len(batch), len(self.languages)))
        for i, text in enumerate(batch):
            data = _lowered(text)
            for a in range(0, len(data), 1 << 20):
                keys = _keys(data[max(0, a - self.order):a + (1 << 20)], self.order)[min(a, self.order):]
                out[i] += self.lengths(keys, self.order).sum(0)
        return out


def fit(docs: DataFrame, trains: Column, order: int = ORDER, train_bytes: int = TRAIN_BYTES) -> Model:
    rows = counted(docs.filter(trains), order, train_bytes).toPandas().sort_values(["lang", "gram"])
    languages = sorted(rows["lang"].unique().tolist())
    at = pd.Categorical(rows["lang"], categories=languages).codes.astype(np.int64)
    return Model(languages, rows["gram"].to_numpy(np.int64).copy(), at, rows["n"].to_numpy(float), order)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its whole text alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches, "text"):
            values = batch.column("text").to_pylist()
            letters = np.array([x.lower() != x.upper() or any(map(str.isalpha, x)) for x in values], dtype=bool)
            names = np.full(len(values), "und", dtype=object)
            score = np.zeros(len(values))
            if model.languages and letters.any():
                rows = np.flatnonzero(letters)
                bits = model.bits([values[i] for i in rows])
                best = bits.argmin(1)
                names[rows] = np.array(model.languages, dtype=object)[best]
                score[rows] = 1 / np.exp2(np.minimum(0, bits.min(1)[:, None] - bits)).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return texts(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return remainder("doc_id", 4) == 2
