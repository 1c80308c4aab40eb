"""Toxicity scores by weak supervision.

Voters. Lexicon voters look for words or word beginnings; one is written down here, the others are mined from a
bounded sample of labelled rows: words and beginnings of ``STEMS`` bytes that toxic texts hold far more often than
others (by a likelihood ratio, so that a few chance meetings do not count), dealt into ``MINED`` lists each. Pattern voters look at capitals, exclamation marks, second-person
attacks and repeated marks. A voter votes on every text.

Label model. The votes of all documents are counted by pattern, so what is gathered is bounded by the number of patterns
and not by documents. Expectation maximisation estimates each voter's hit rates given the hidden class;
labelled rows count as observed. Voters that agree beyond what the class explains are correlated: their
covariance within the classes is estimated too, and each voter's evidence is divided by one plus the sum of its positive
correlations, so a clique of voters does not count as many.

Classifier. A logistic model over the voters' hits (any, and the log of how many) is trained on the posteriors of
a bounded sample of rows, and scores every whole text.

Defined results: an empty or null text has no hits and is scored like any other; labels that are null do not count;
without labels the written lexicon and the patterns vote alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import binaries, remainder, share, small_batches, texts

SAMPLE = 20_000    # labelled rows to mine voters from, and rows to train the classifier on
STEMS = (4, 5, 6)
SURE = 28.0        # likelihood ratio of a mined entry: chance alone reaches it once in ten million
UNLABELLED = 0.05  # weight of a row without a label in the label model
MINED = 3          # voters per kind of mined entry
ENTRIES = 600      # mined entries per kind at most

# Written lexicon: English insults in common use.
LEXICON = tuple(w.encode() for w in (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "scum", "trash", "garbage", "loser", "losers", "clown", "pathetic",
    "worthless", "disgusting", "jerk", "fool", "imbecile", "vermin", "filth", "coward", "liar"))
WORD = re.compile(rb"[a-z\x80-\xff]+")
PATTERNS = (
    ("shouting", re.compile(rb"(?:\b[A-Z]{3,}\b[\s!?.,]*){4,}")),
    ("exclaiming", re.compile(rb"!{2,}")),
    ("attack", re.compile(rb"(?i)\b(?:you|u)(?:'re| are| r)\s+(?:an?\s+)?(?:idiot|moron|loser|pathetic|worthless|stupid|disgusting|scum|trash|clown)")),
    ("masked", re.compile(rb"\b\w[*#@$%]{2,}\w*\b")),
)


@dataclass(frozen=True)
class Voters:
    """Entry lists by voter; a voter's hits are the distinct words of a text that match an entry."""

    words: dict[bytes, int]                # word -> voter
    stems: dict[int, dict[bytes, int]]     # length -> beginning -> voter
    size: int

    def hits(self, text: bytes | None) -> np.ndarray:
        out = np.zeros(self.size, dtype=np.int64)
        text = text or b""
        distinct = set(WORD.findall(text.lower()))
        for w in distinct & self.words.keys():
            out[self.words[w]] += 1
        for n, stems in self.stems.items():
            if stems:
                for s in {w[:n] for w in distinct} & stems.keys():
                    out[stems[s]] += 1
        for i, (_, pattern) in enumerate(PATTERNS, self.size - len(PATTERNS)):
            out[i] = len(pattern.findall(text))
        return out


def _entries(words: set[bytes]) -> set[tuple[int, bytes]]:
    """What can be mined from a text: whole words (length 0) and beginnings."""
    out = {(0, w) for w in words}
    for n in STEMS:
        out |= {(n, w[:n]) for w in words if len(w) > n}
    return out


def mine(labelled: DataFrame, sample: int = SAMPLE) -> Voters:
    """Voters from ``doc_id, text, y`` rows; at most about ``sample`` of them are read in full."""
    n = labelled.count()
    rows = labelled.filter(share(F.col("doc_id")) < sample / max(1, n)).select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        totals = Counter()

        def flush():
            for y, counts in seen.items():
                keys = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.binary()), pa.array([y] * len(keys), pa.int32()),
                     pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "entry", "y", "n"])
                counts.clear()

        for batch in small_batches(batches, "text"):
            for text, y in zip(binaries(batch, "text"), batch.column("y").to_pylist()):
                seen[y].update(_entries(set(WORD.findall((text or b"").lower()))))
                totals[y] += 1
            if sum(map(len, seen.values())) > 1 << 20:
                yield from flush()
        yield from flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1] * len(totals), pa.int32()), pa.array([b""] * len(totals), pa.binary()), pa.array(list(totals), pa.int32()),
             pa.array(list(totals.values()), pa.int64())], names=["kind", "entry", "y", "n"])

    counts = materialize(rows.mapInArrow(run, "kind int, entry binary, y int, n long").groupBy("kind", "entry").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good")), "entries")
    total = counts.filter("kind = -1").agg(F.sum("bad"), F.sum("good")).first()
    bad, good = total[0] or 0, total[1] or 0
    words, stems, voter = dict.fromkeys(LEXICON, 0), {k: {} for k in STEMS}, 1
    def part(n, of):
        """n * ln(n / expected), for a row's share of all texts that hold the entry."""
        expected = F.lit(float(of)) * (F.col("bad") + F.col("good")) / max(1, bad + good)
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0) + F.when(
            n < of, (F.lit(of) - n) * F.log((F.lit(of) - n) / (F.lit(float(of)) - expected))).otherwise(0.0)

    ratio = 2 * (part(F.col("bad"), bad) + part(F.col("good"), good))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    for kind in (0, *STEMS):
        # Bounded by ENTRIES; the longest odds first.
        best = counts.filter(F.col("kind") == kind).withColumn("odds", odds).filter((odds > 2) & (ratio > SURE)).orderBy(
            F.desc("odds"), "entry").limit(ENTRIES).collect()
        target = stems[kind] if kind else words
        for i, r in enumerate(best):
            if bytes(r["entry"]) not in target:
                target[bytes(r["entry"])] = voter + i % MINED
        voter += MINED
    return Voters(words, stems, voter + len(PATTERNS))


def hits(rows: DataFrame, voters: Voters) -> DataFrame:
    """``doc_id, row_key, hits``: each voter's hits in every whole text; one narrow pass."""
    shared = rows.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [shared.value.hits(t) for t in binaries(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "row_key", "hits"])

    return rows.mapInArrow(run, "doc_id long, row_key long, hits array<long>")


@dataclass(frozen=True)
class LabelModel:
    prior: float
    rates: np.ndarray   # [class, voter]: chance of a vote
    discount: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[1]) - np.log(self.rates[0])
        off = np.log1p(-self.rates[1]) - np.log1p(-self.rates[0])
        z = math.log(self.prior / (1 - self.prior)) + (np.where(votes, on, off) / self.discount).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def label_model(votes: np.ndarray, n: np.ndarray, y: np.ndarray, rounds: int = 40) -> LabelModel:
    """Fit on distinct vote patterns with counts; ``y``: 0, 1, or -1 where the class is not known."""
    v = votes.astype(float)
    known = y >= 0
    # Unlabelled rows weigh less where labels anchor the classes; else the model may settle on another split.
    n = np.where(known, n, n * UNLABELLED) if set(y[known]) == {0, 1} else n
    width = v.shape[1]
    strong = v[:, :width - len(PATTERNS)].sum(1) > 0
    p = np.where(known, y, np.where(strong, 0.8, 0.02)).astype(float)
    model = LabelModel(0.1, np.full((2, width), 0.5), np.ones(width))
    for _ in range(rounds):
        rates = []
        for w in (n * (1 - p), n * p):
            rates.append(((v * w[:, None]).sum(0) + 0.5) / (w.sum() + 1))
        rates = np.clip(np.array(rates), 1e-4, 1 - 1e-4)
        prior = float(np.clip((n * p).sum() / n.sum(), 0.01, 0.99))
        # What two voters share beyond the class makes them weaker evidence together.
        total = np.zeros((width, width))
        for c, w in enumerate((n * (1 - p), n * p)):
            d = v - rates[c]
            cov = (d * w[:, None]).T @ d / max(1.0, w.sum())
            sd = np.sqrt(np.diag(cov)) + 1e-6
            total += cov / sd[:, None] / sd[None, :] * (w.sum() / n.sum())
        np.fill_diagonal(total, 0)
        model = LabelModel(prior, rates, 1 + np.clip(total, 0, None).sum(1))
        p = np.where(known, y, model.posterior(votes))
    return model


def _features(found: np.ndarray) -> np.ndarray:
    return np.hstack([found > 0, np.log1p(found), (found[:, :-len(PATTERNS)].sum(1, keepdims=True) > 0)]).astype(float)


def _logistic(x: np.ndarray, p: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.full(x1.shape[1], penalty * max(1, len(x)))
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x1 @ w
        return float((np.logaddexp(0, z) - p * z).sum() + (ridge * w * w).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (q - p) + ridge * w
        h = (x1 * (q * (1 - q) + 1e-6)[:, None]).T @ x1 + np.diag(ridge)
        move, size = np.linalg.solve(h, g), 1.0
        while (then := loss(w - size * move)) > now and size > 1e-4:
            size /= 2
        if then > now - 1e-9 * abs(now):
            break
        w, now = w - size * move, then
    return w[:-1], float(w[-1])


def scored(docs: DataFrame, labels: DataFrame, trains: Column, target: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, row_key, score, predicted`` of every row; labels count where ``trains`` (over doc_id) holds."""
    spark = docs.sparkSession
    rows = texts(docs)
    known = materialize(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).filter(
        trains & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y")), "labels")
    voters = mine(rows.filter(trains).join(known, "doc_id"), sample)
    found = materialize(hits(rows, voters).join(known, "doc_id", "left"), "hits")
    votes = F.transform("hits", lambda h: (h > 0).cast("int"))
    patterns = found.groupBy(F.concat_ws("", votes).alias("votes"), F.coalesce("y", F.lit(-1)).alias("y")).count().toPandas().sort_values(["votes", "y"])
    if patterns.empty:
        return found.select("doc_id", "row_key", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    table = np.array([[c == "1" for c in v] for v in patterns["votes"]], dtype=bool).reshape(-1, voters.size)
    model = label_model(table, patterns["count"].to_numpy(float), patterns["y"].to_numpy(int))
    n = found.count()
    taught = found.filter(share(F.col("doc_id")) < sample / max(1, n)).select("hits").toPandas()["hits"]
    x = np.array(sorted(taught.map(tuple)), dtype=float).reshape(-1, voters.size)
    weights, bias = _logistic(_features(x), model.posterior(x > 0))
    line = spark.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = line.value
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("hits").to_pylist(), dtype=float)
                z = np.clip(_features(x) @ weights + bias, -50, 50)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row_key"), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "row_key", "score"])

    return found.select("doc_id", "row_key", "hits").mapInArrow(run, "doc_id long, row_key long, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def held_out() -> Column:
    return remainder("doc_id", 5) == 0
