"""Quality classifier: a sparse ensemble of rules cut from trees, compiled into Spark columns.

Each document is described by statistics of its whole text. Small trees, grown on resampled labelled rows, give
conjunctive rules (every node's path); a logistic model with an L1 penalty keeps the few that matter, and
the survivors become one column expression over the statistics.

Training reads a sample of labelled rows, bounded by ``SAMPLE`` rows in expectation and chosen by a hash of the
id; it is small enough for the driver. Everything else covers all rows.

Defined results: an empty or null text has all statistics 0 and is scored like any other; rows with a null
label do not train; without labelled rows of both kinds every document gets the share of good labels (0.5 if
there is none).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from ..session import materialize
from .common import binaries, remainder, share, small_batches, texts, unused

SAMPLE = 20_000
TREES, DEPTH, BINS = 60, 3, 24

STATS = (
    "log_bytes", "upper", "digits", "spaces", "lines", "marks", "bars", "bangs", "stops", "other_marks", "wide",
    "log_words", "word_bytes", "long_words", "distinct_words", "top_word", "marked_words", "upper_words",
    "repeated_lines", "line_bytes", "packed", "repeated_pairs",
)

_UPPER, _LETTERS = np.zeros(256), np.zeros(256)
_UPPER[65:91] = 1
_LETTERS[65:91] = _LETTERS[97:123] = 1
_LETTERS[128:] = 1
_MARKS = re.compile(rb"[#$%&*+=@^_~<>{}\[\]\\|!]{2,}")
_CAPITALS = re.compile(rb"[A-Z]{3,}")


def _of(histogram: np.ndarray, characters: bytes) -> float:
    return float(histogram[list(characters)].sum())


def statistics(text: bytes | None) -> list[float]:
    """The values of :data:`STATS` for one whole text."""
    if not text:
        return [0.0] * len(STATS)
    h = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256).astype(float)
    n = len(text)
    letters = max(1.0, float((h * _LETTERS).sum()))
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    pairs = set(zip(words, words[1:]))
    return [
        float(np.log1p(n)), float((h * _UPPER).sum()) / letters, _of(h, b"0123456789") / n, _of(h, b" ") / n,
        _of(h, b"\n") / n, _of(h, b"#$%&*+=@^_~") / n, _of(h, b"|") / n, _of(h, b"!") / n, _of(h, b".,;:?") / n,
        _of(h, b"<>{}[]()\\/\"'-") / n, float(h[128:].sum()) / n, float(np.log1p(len(words))),
        float(lengths.mean()) if len(words) else 0.0, float((lengths > 12).sum()) / m, len(counts) / m,
        max(counts.values(), default=0) / m, len(_MARKS.findall(text)) / m, len(_CAPITALS.findall(text)) / m,
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
        len(zlib.compress(text, 1)) / n, 1 - len(pairs) / max(1, len(words) - 1),
    ]


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key`` and the statistics of every row; one narrow pass over whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = np.array([statistics(x) for x in binaries(batch, "text")], dtype=float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), *(pa.array(c) for c in rows.T)],
                names=["doc_id", "row_key", *STATS])

    return texts(docs).mapInArrow(run, "doc_id long, row_key long, " + ", ".join(f"{s} double" for s in STATS))


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, all columns, and the statistics of each row as a struct; one narrow pass."""
    of = pa.struct([(s, pa.float64()) for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = np.array([statistics(x) for x in binaries(batch, "text")], dtype=float).reshape(-1, len(STATS))
            found = pa.StructArray.from_arrays([pa.array(c) for c in rows.T], fields=list(of))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))])
    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """All of ``(statistic, is above, bound)`` hold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, above, bound in self.terms:
            out &= (x[:, k] > bound) == above
        return out

    def column(self, of: Callable[[str], Column]) -> Column:
        return reduce(Column.__and__, (
            of(STATS[k]) > bound if above else of(STATS[k]) <= bound for k, above, bound in self.terms))


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        """The score as one expression over the statistics; ``of`` gives a statistic's column.

        The statistics are bound as one array, as Spark makes no Java of what is inside a lambda: compiling some hundred
        branches took several hundred megabytes of the driver and of every executor.
        """
        def score(x: Column) -> Column:
            total = reduce(Column.__add__, (F.when(r.column(lambda s: x[STATS.index(s)]), F.lit(w)).otherwise(F.lit(0.0))
                                            for r, w in zip(self.rules, self.weights)), F.lit(self.bias))
            return 1 / (1 + F.exp(-total))

        return let(F.array(*(of(s) for s in STATS)), score)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights):
            total = total + w * r.holds(x)
        return 1 / (1 + np.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, bounds: list[np.ndarray], features: np.ndarray, depth: int, terms: tuple, out: set) -> None:
    """Grow one tree by Gini gain and note the path to each of its nodes."""
    if terms:
        out.add(Rule(tuple(sorted(terms))))
    n, good = len(y), float(y.sum())
    if not depth or n < 20 or good in (0, n):
        return
    best = (1e-9, None)
    for k in features:
        above = x[:, k, None] > bounds[k]
        right = above.sum(0)
        right_good = (above & (y[:, None] > 0)).sum(0)
        left, left_good = n - right, good - right_good
        ok = (right >= 5) & (left >= 5)
        if not ok.any():
            continue
        r, l = np.maximum(1, right), np.maximum(1, left)
        impurity = right_good * (1 - right_good / r) + left_good * (1 - left_good / l)
        gain = np.where(ok, good * (1 - good / n) - impurity, -1)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), (k, float(bounds[k][at])))
    if best[1] is None:
        return
    k, bound = best[1]
    above = x[:, k] > bound
    _paths(x[above], y[above], bounds, features, depth - 1, (*terms, (int(k), True, bound)), out)
    _paths(x[~above], y[~above], bounds, features, depth - 1, (*terms, (int(k), False, bound)), out)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradients; the bias is free."""
    n, d = z.shape
    # The bias is one more column of ones, which is not stored: the table is the largest thing the driver holds.
    times = lambda v: z @ v[:-1] + v[-1]
    back = lambda r: np.append(z.T @ r, r.sum())
    v = np.random.default_rng(0).normal(size=d + 1).astype(z.dtype)
    for _ in range(20):
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1 / (0.26 * float(v @ back(times(v))) / n)
    w = u = np.zeros(d + 1, z.dtype)
    w[-1] = u[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    t = 1.0
    for _ in range(steps):
        g = back(1 / (1 + np.exp(-times(u))) - y) / n
        new = u - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * penalty)
        t1 = (1 + math.sqrt(1 + 4 * t * t)) / 2  # a numpy number would turn all into doubles, the table at every step too
        u = new + (t - 1) / t1 * (new - w)
        w, t = new, t1
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, penalty: float = 4e-4) -> RuleEnsemble:
    """Rules from resampled trees, then their weights."""
    if not len(y) or y.min() == y.max():
        share_ = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
        return RuleEnsemble((), (), float(np.log(share_ / (1 - share_))))
    rng = np.random.default_rng(seed)
    bounds = []
    for k in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 2)[1:-1]))
        values = np.unique(x[:, k])
        bounds.append(np.unique(np.append(cuts, values[0])) if len(values) > 1 else cuts)
    found: set[Rule] = set()
    rare, common = np.flatnonzero(y == (y.mean() < 0.5)), np.flatnonzero(y != (y.mean() < 0.5))
    for _ in range(TREES):
        # Both kinds weigh alike in a tree, so that it spends its splits on the rarer one.
        rows = np.concatenate([rng.choice(rare, 600), rng.choice(common, 600)])
        features = rng.choice(x.shape[1], size=max(3, x.shape[1] // 3), replace=False)
        _paths(x[rows], y[rows], bounds, features, DEPTH, (), found)
    rules, columns, seen = [], [], {}
    for r in sorted(found, key=lambda r: (len(r.terms), r.terms)):
        held = r.holds(x)
        key = hash(held.tobytes())
        if 0 < held.mean() < 1 and not any((columns[i] == held).all() for i in seen.get(key, ())):
            seen.setdefault(key, []).append(len(rules))
            rules.append(r)
            columns.append(held)
    z = np.array(columns, dtype=np.float32).T
    del columns
    w, bias = _lasso(z, y.astype(np.float32), penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-3)
    return RuleEnsemble(tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept), bias)


def train(docs: DataFrame, labels: DataFrame, trains: Column, target: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on at most about ``sample`` labelled rows among those where ``trains`` (over doc_id) holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("y")).dropna()
    chosen = materialize(known.filter(trains & (share(F.col("doc_id")) < sample / max(1, known.filter(trains).count()))), "labels")
    rows = described(docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")).join(chosen, "doc_id").select(
        *STATS, "y").toArrow()
    known = np.column_stack([rows[c].to_numpy() for c in (*STATS, "y")])
    known = known[np.lexsort(known.T[::-1])]
    return fit(known[:, :-1], known[:, -1])


def scored(docs: DataFrame, labels: DataFrame, trains: Column, target: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, row_key, score, predicted`` of every row; rows where ``trains`` (over doc_id) holds teach."""
    model = train(docs, labels, trains, target, sample)
    return described(docs).select("doc_id", "row_key", model.column().alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that a model taught by all labels does not reject."""
    name = unused(docs, "statistics")
    model = train(docs, labels, F.lit(True), target, sample)
    return with_statistics(docs, name).filter(model.column(lambda s: F.col(name)[s]) >= 0.5).drop(name)


def held_out() -> Column:
    return remainder("doc_id", 3) == 1
