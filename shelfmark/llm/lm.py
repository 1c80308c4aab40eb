"""Scores of whole texts under a log-bilinear language model and a smoothed unigram model.

Tokens are lower-cased (A-Z only) runs of other than white space, and one end per text. Counts are taken over
all training texts. Words of the ``HEAD`` most frequent, a fixed number, travel to the tasks with their counts; the
others are joined with the count table, one row per document and distinct rare word.

The log-bilinear model predicts a token from the two before it: its score is the inner product of the token's vector with
a sum of position-wise transformed context vectors, plus a bias. It knows the most frequent words, more of them the more
tokens there are (:func:`vocabulary_size`), the end, and one outcome for all other words, inside which a word has its
smoothed share of the counts. Outcomes are dealt to classes, a token's probability is that of its class times its own
among the class, both normalised exactly. It is trained by noise-contrastive estimation on all training texts: each round
a share of the texts is learnt from in parallel tasks that start from the same parameters; their parameters are averaged,
every row weighted by how often a task changed it. Which texts meet in a task follows the partitions, so scores
of the same table in other files differ a little.

Defined results: a null or empty text is the end alone; with no training texts every token has the share a uniform
model gives it.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import remainder, share, small_batches, texts

HEAD = 1 << 17
SAMPLE = 1_000_000      # tokens a task learns from in a round, while there are cores for all tasks
ROUNDS = 4              # shares of the texts, one after the other
PASSED = 1_600_000      # texts of fewer tokens are passed over again, EPOCHS times at most
CHUNK = 1 << 20         # tokens put in random order at once
FLAT = 64               # up to so many outcomes are one class
DIM, NOISE, EPOCHS, BATCH, RATE = 24, 64, 4, 512, 0.08
ALPHA = 0.1
END, OTHER = 0, 1


def split(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts of a batch, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))  # at \x20 and \x09-\x0d
    offsets, found = lists.offsets.to_numpy(), lists.flatten()
    found = found.cast(pa.binary())
    full = pc.binary_length(found).to_numpy() > 0  # white space at an end of a text leaves an empty word there
    if not full.all():
        offsets, found = np.append(0, np.cumsum(full))[offsets], found.filter(pa.array(full))
    return found, np.diff(offsets).astype(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, n`` over all texts; tasks combine what they can hold before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> pa.Table:
            table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table([table["word"], table["n_sum"]], names=["word", "n"])

        for batch in small_batches(batches, "text"):
            seen = pc.value_counts(split(batch)[0])
            held.append(pa.table([seen.field("values"), seen.field("counts")], names=["word", "n"]))
            size += len(seen)
            if size > 1 << 20:
                held = [merged()]
                size = len(held[0])
                if size > 1 << 19:
                    yield from held[0].to_batches(1 << 16)
                    held, size = [], 0
        if held:
            yield from merged().to_batches(1 << 16)

    return rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``size``, most frequent first, all words of a count or none.

    Found by a histogram of logarithms of the counts, so no more than they are collected.
    """
    bucket = F.floor(F.log2("n") * 16)
    levels = sorted(((r["bucket"], r["count"]) for r in counts.groupBy(bucket.alias("bucket")).count().collect()), reverse=True)
    taken, least = 0, None
    for level, n in levels:
        if taken + n > size:
            break
        taken, least = taken + n, level
    if least is None:
        return []
    rows = counts.filter(bucket >= least).toArrow()
    return sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist()), key=lambda r: (-r[1], r[0]))


def vocabulary_size(tokens: int) -> int:
    """Words the model knows: 1,022 up to 32,000 tokens, and ten times as many for a thousand times the tokens."""
    return max(1022, int(32 * tokens ** (1 / 3)))


def class_starts(share_: np.ndarray) -> np.ndarray:
    """First outcome of every class. Classes are runs of outcomes with like sums of root shares, so frequent words share
    theirs with few others; the end and the other words are alone."""
    if len(share_) <= FLAT:
        return np.zeros(1, dtype=np.int64)
    mass = np.cumsum(np.sqrt(share_[2:]))
    number = (mass / mass[-1] * math.sqrt(len(share_)) * (1 - 1e-9)).astype(np.int64)
    return np.concatenate([[END, OTHER], 2 + np.flatnonzero(np.diff(number, prepend=-1))])


def _log_sum(z: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials of every row, which are written over."""
    top = z.max(1, keepdims=True)
    # Sums that cannot leave the type's range need no shift.
    if not len(z) or top.max() > 60 or top.min() < -60:
        z -= top
    else:
        top[:] = 0
    np.exp(z, out=z)
    return np.log(z @ np.ones(z.shape[1], z.dtype)) + top[:, 0]


def _short(rows: np.ndarray, limit: int) -> np.ndarray:
    """Row numbers below ``limit`` in a type that numpy sorts by radix, if they fit."""
    return rows.astype(np.uint16) if limit <= 1 << 16 else rows


def _odds(z: np.ndarray, weight: np.ndarray | float = 1) -> np.ndarray:
    """Logistic function of the negative of ``z``, times ``weight``, written over it."""
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    return np.divide(weight, z, out=z)


@dataclass(frozen=True)
class LogBilinear:
    """Rows of ``target`` and ``groups`` end in the bias; ``scales`` are of the last and the last but one token."""

    ids: dict[bytes, int]
    starts: np.ndarray
    context: np.ndarray
    target: np.ndarray
    groups: np.ndarray
    scales: np.ndarray

    # The tables of a model with one class.
    @property
    def first(self) -> np.ndarray:
        return (self.context * self.scales[0]) @ self.target[:, :-1].T + self.target[:, -1]

    @property
    def second(self) -> np.ndarray:
        return (self.context * self.scales[1]) @ self.target[:, :-1].T

    @property
    def normaliser(self) -> np.ndarray:
        return np.stack([_log_sum(self.first + row) for row in self.second])

    def logs(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, step: int = 1 << 17) -> np.ndarray:
        """Natural log probabilities of tokens after ``two, one``."""
        out, block = np.empty(len(ids)), 1 << 11  # rows of scores the processor's cache holds
        ends = np.append(self.starts[1:], len(self.target))
        scores = np.empty(block * max(len(self.groups), *(ends - self.starts)), self.target.dtype)
        for a in range(0, len(ids), step):
            w = ids[a:a + step]
            # Contexts come again and again; the classes are summed up once for each.
            seen, which = np.unique(one[a:a + step] * len(self.target) + two[a:a + step], return_inverse=True)
            last, before = np.divmod(seen, len(self.target))
            ctx = self.context.take(last, 0) * self.scales[0]
            ctx += self.context.take(before, 0) * self.scales[1]
            totals = np.empty(len(ctx))
            for b in range(0, len(ctx), block):
                part = ctx[b:b + block]
                z = np.matmul(part, self.groups[:, :-1].T, out=scores[:len(part) * len(self.groups)].reshape(len(part), -1))
                z += self.groups[:, -1]
                totals[b:b + block] = _log_sum(z)
            group = np.searchsorted(self.starts, w, side="right") - 1
            log = np.einsum("ij,ij->i", ctx.take(which, 0), self.groups[:, :-1].take(group, 0)) + self.groups[group, -1] - totals[which]
            order = np.argsort(_short(group, len(self.starts)), kind="stable")
            bounds = np.searchsorted(group[order], np.arange(len(self.starts) + 1))
            for g in np.flatnonzero((np.diff(bounds) > 0) & (ends - self.starts > 1)):
                members = self.target[self.starts[g]:ends[g]]
                for b in range(bounds[g], bounds[g + 1], block):
                    at = order[b:min(b + block, bounds[g + 1])]
                    z = np.matmul(ctx.take(which[at], 0), members[:, :-1].T, out=scores[:len(at) * len(members)].reshape(len(at), -1))
                    z += members[:, -1]
                    own = z[np.arange(len(at)), w[at] - self.starts[g]].astype(np.float64)
                    log[at] += own - _log_sum(z)
            out[a:a + step] = log
        return out


def ended(values: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The values of all texts, one after the other, with ``end`` after each text."""
    out = np.full(len(values) + len(sizes), end, dtype=np.int64)
    inside = np.ones(len(out), dtype=bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    out[inside] = values
    return out


def windows(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts of so many tokens each, their ends counted, with the last and the last but one token before each.

    Before a text there are ends, and the text before has left one of them.
    """
    one, two = (np.concatenate([np.full(k, END), ids])[:len(ids)] for k in (1, 2))
    two[np.cumsum(sizes)[:-1]] = END
    return ids, one, two


class Trainer:
    """Noise-contrastive estimation with noise from the unigram distribution ``share_``.

    Parameters are rows of four tables: context vectors, vectors of outcomes and of classes with their bias, scales.
    ``state`` sums the squared gradients of every row, ``changes`` counts what it was changed for.
    """

    def __init__(self, share_: np.ndarray, dim: int = DIM, noise: int = NOISE, seed: int = 1):
        rng, size = np.random.default_rng(seed), len(share_)
        self.share, self.noise, self.starts = share_, noise, class_starts(share_)
        self.of = np.searchsorted(self.starts, np.arange(size), side="right") - 1
        self.group_share = np.add.reduceat(share_, self.starts)
        vectors = lambda p: np.column_stack([rng.normal(0, 0.1, (len(p), dim)), np.log(p)])
        tables = (rng.normal(0, 0.1, (size, dim)), vectors(share_), vectors(self.group_share), np.array([[1.0], [0.5]]).repeat(dim, 1))
        self.tables = [t.astype(np.float32) for t in tables]
        self.state = [np.full(len(t), 1e-6, dtype=np.float32) for t in self.tables]
        self.changes = [np.zeros(len(t)) for t in self.tables]

    def model(self, ids: dict[bytes, int]) -> LogBilinear:
        return LogBilinear(ids, self.starts, *self.tables)

    def _step(self, i: int, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        if rows is None:
            own = slice(None)
        else:
            order = np.argsort(_short(rows, len(self.tables[i])), kind="stable")
            rows = rows.take(order)
            new = np.ones(len(rows) + 1, dtype=bool)
            np.not_equal(rows[1:], rows[:-1], out=new[1:-1])
            first = new.nonzero()[0]
            own = rows.take(first[:-1])
            g = np.add.reduceat(g.take(order, 0), first[:-1], axis=0)
        table, state = (t if rows is None else t.take(own, 0) for t in (self.tables[i], self.state[i]))
        squares = state + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
        self.state[i][own] = squares
        g *= (np.float32(RATE) / np.sqrt(squares))[:, None]
        table -= g
        if rows is not None:
            self.tables[i][own] = table

    def learn(self, w: np.ndarray, one: np.ndarray, two: np.ndarray, rng: np.random.Generator) -> None:
        context, target, groups, scales = self.tables
        log_noise, log_groups = (np.log(x * self.noise).astype(np.float32) for x in (self.share, self.group_share))
        cumulative, classes = np.cumsum(self.share), groups if len(groups) > 1 else groups[:0]
        weight = np.concatenate([np.ones(self.noise), self.group_share[:len(classes)] * self.noise]).astype(np.float32)
        order = rng.permutation(len(w))
        drawn = rng.random((-(-len(w) // BATCH), self.noise)) * cumulative[-1]
        drawn = np.minimum(np.searchsorted(cumulative, drawn), len(self.share) - 1)
        scores = np.empty((min(BATCH, len(w)), len(weight)), np.float32)
        for a in range(0, len(w), BATCH):
            at = order[a:a + BATCH]
            x, x1, x2 = w.take(at), one.take(at), two.take(at)
            n, c1, c2 = np.float32(len(at)), context.take(x1, 0), context.take(x2, 0)
            ctx = np.ones((len(at), target.shape[1]), np.float32)
            np.add(c1 * scales[0], c2 * scales[1], out=ctx[:, :-1])
            other = drawn[a // BATCH]
            vectors = target.take(x, 0)
            good = _odds(log_noise[x] - np.einsum("ij,ij->i", ctx, vectors)) - 1
            # One set of noise tokens serves the whole batch, and all classes serve as noise, each with its expected number
            # of draws; so their scores are one matrix product. What is taken from the scores is taken from the bias.
            against = np.concatenate([target.take(other, 0), classes])
            against[:self.noise, -1] -= log_noise[other]
            against[self.noise:, -1] -= log_groups[:len(classes)]
            g = _odds(np.matmul(ctx, np.negative(against).T, out=scores[:len(at)]), weight)
            if len(classes):
                own = self.noise + self.of[x]
                g[np.arange(len(at)), own] += g[np.arange(len(at)), own] / weight[own] - 1
            g_ctx = g @ against[:, :-1]
            g_ctx += good[:, None] * vectors[:, :-1]
            ctx /= n
            g_rows = g.T @ ctx
            if len(classes):
                self._step(2, g_rows[self.noise:])
            ctx *= good[:, None]
            self._step(1, np.concatenate([ctx, g_rows[:self.noise]]), np.concatenate([x, other]))
            g_ctx /= n
            g_scales = np.stack([np.einsum("ij,ij->j", g_ctx, c1), np.einsum("ij,ij->j", g_ctx, c2)])
            self._step(0, np.concatenate([g_ctx * scales[0], g_ctx * scales[1]]), np.concatenate([x1, x2]))
            self._step(3, g_scales)
        size = len(self.share)
        self.changes[0] += np.bincount(one, minlength=size) + np.bincount(two, minlength=size)
        self.changes[1] += np.bincount(np.append(w, drawn), minlength=size)
        self.changes[2] += len(drawn) if len(classes) else 0
        self.changes[3] += len(drawn)

    def changed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers over all tables, changes, and values with the state, of the rows that were changed."""
        rows, n, values, base = [], [], [], 0
        for table, state, changes in zip(self.tables, self.state, self.changes):
            own = np.flatnonzero(changes)
            full = np.zeros((len(own), self.tables[1].shape[1] + 1))
            full[:, :table.shape[1]], full[:, -1] = table[own], state[own]
            rows, n, values, base = [*rows, own + base], [*n, changes[own]], [*values, full], base + len(table)
        return np.concatenate(rows), np.concatenate(n), np.concatenate(values)

    def take(self, rows: np.ndarray, values: np.ndarray) -> None:
        base = 0
        for table, state in zip(self.tables, self.state):
            mine = (rows >= base) & (rows < base + len(table))
            at = rows[mine] - base
            table[at], state[at] = values[mine, :table.shape[1]], values[mine, -1]
            base += len(table)


def train(sequences: list[np.ndarray], ids: dict[bytes, int], share_: np.ndarray, seed: int = 1,
          dim: int = DIM, noise: int = NOISE, epochs: int = EPOCHS) -> LogBilinear:
    """A model of sequences that fit into one process."""
    trainer, rng = Trainer(share_, dim, noise, seed), np.random.default_rng(seed)
    for _ in range(epochs):
        trainer.learn(*windows(np.concatenate(sequences), np.array([len(x) for x in sequences])), rng)
    return trainer.model(ids)


def train_all(teaching: DataFrame, tokens: int, ids: dict[bytes, int], share_: np.ndarray, sample: int = SAMPLE) -> LogBilinear:
    """A model of all texts of ``teaching`` (``row_key, text``), ``tokens`` with the ends.

    A round's parameters are averaged by one aggregate over rows of parameters, so the driver receives one set of them.
    """
    context = teaching.sparkSession.sparkContext
    trainer = Trainer(share_)
    names = [f"x{i}" for i in range(DIM + 2)]
    rounds = ROUNDS if tokens > sample else 1
    tasks = min(max(1, tokens // (rounds * sample)), 2 * context.defaultParallelism)
    for number in range(rounds * min(EPOCHS, max(1, -(-PASSED // max(1, tokens)))) if tokens else 0):
        shared = context.broadcast((trainer, ids))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            trainer, ids = copy.deepcopy(shared.value[0]), shared.value[1]
            rng = np.random.default_rng((number, TaskContext.get().partitionId()))
            held, size = [], 0
            known = pa.array(ids, pa.binary())

            def learn() -> None:
                if held:
                    trainer.learn(*map(np.concatenate, zip(*held)), rng)

            for batch in small_batches(batches, "text"):
                found, sizes = split(batch)
                at = pc.fill_null(pc.index_in(found, known), OTHER - 2).to_numpy() + 2
                tokens, ends, a = windows(ended(at, sizes, END), sizes + 1), np.cumsum(sizes + 1), 0
                while (full := np.searchsorted(ends, a + CHUNK - size)) < len(ends):
                    held.append([t[a:ends[full]] for t in tokens])
                    learn()
                    held, size, a = [], 0, ends[full]
                held.append([t[a:] for t in tokens])
                size += ends[-1] - a
            learn()
            rows, n, values = trainer.changed()
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(n), *(pa.array(v) for v in (values * n[:, None]).T.copy())], names=["row", "n", *names])

        part = teaching.filter(F.floor(share(F.col("row_key")) * rounds) == number % rounds).select("text").coalesce(tasks)
        sums = part.mapInArrow(run, "row long, n double, " + ", ".join(f"{x} double" for x in names)).groupBy("row").agg(
            F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).toArrow()
        trainer.take(sums["row"].to_numpy(), np.column_stack([sums[x].to_numpy() for x in names]) / sums["n"].to_numpy()[:, None])
        shared.unpersist()
    return trainer.model(ids)


def scored(docs: DataFrame, trains: Column, head: int = HEAD, vocabulary: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, row_key, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Texts of rows where ``trains`` (over doc_id) holds are learnt from.
    """
    spark = docs.sparkSession
    rows = texts(docs)
    teaching = rows.filter(trains)
    counts = materialize(word_counts(teaching), "counts")
    known = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = teaching.count()
    tokens, kinds = (known["n"] or 0) + ends, known["v"] + (ends > 0)
    frequent = _head(counts, head)
    known_words = frequent[:vocabulary or vocabulary_size(tokens)]
    ids = {w: i for i, (w, _) in enumerate(known_words, 2)}
    within = sum(n for _, n in known_words)
    rest, rest_kinds = tokens - ends - within, known["v"] - len(ids)
    share_ = np.array([ends, rest, *(n for _, n in known_words)], dtype=float) + 1
    share_ /= share_.sum()
    model = train_all(teaching, tokens, ids, share_, sample)
    # Of the first of them the model knows, two more than a word's place is its outcome.
    place = pa.array([w for w, _ in frequent], pa.binary())
    head_logs = np.array([math.log10(n + ALPHA) for _, n in frequent] + [0.0, 0.0])
    shared = spark.sparkContext.broadcast((place, head_logs, model))
    base_total = math.log10(tokens + ALPHA * (kinds + 1))
    # Probability of a word among the words outside the vocabulary, one unseen word included.
    rest_total = math.log10(rest + ALPHA * (rest_kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, logs, model = shared.value
        held = len(model.ids)
        for batch in small_batches(batches, "text"):
            found, sizes = split(batch)
            at = pc.fill_null(pc.index_in(found, place), -1).to_numpy()
            # An end is at -2, so it and rare words find one of the zeros after the logarithms.
            tokens, starts = ended(at, sizes, -2), np.cumsum(sizes + 1) - sizes - 1
            # Every text has its end, so none of the sums is over nothing. Long doubles, so that they round once.
            each = lambda x, t: np.add.reduceat(x.astype(t), starts)
            ids = np.where((tokens >= 0) & (tokens < held), tokens + 2, np.where(tokens == -2, END, OTHER))
            model_logs = each(model.logs(*windows(ids, sizes + 1)), float) / math.log(10)
            log, outside = logs[tokens], tokens >= held
            n_rare = each(tokens == -1, np.int64)
            # Rare words of each text, each with its number there.
            own = np.flatnonzero(at < 0)
            kinds = found.take(pa.array(own)).dictionary_encode()
            size = max(1, len(kinds.dictionary))
            pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[own] * size + kinds.indices.to_numpy(), return_counts=True)
            rare = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(pairs, np.arange(len(sizes) + 1) * size), pa.int32()),
                pa.StructArray.from_arrays([kinds.dictionary.take(pa.array(pairs % size)), pa.array(times, pa.int64())], names=["word", "times"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes + 1), pa.array(sizes - n_rare),
                 *(pa.array(each(x, np.longdouble).astype(float)) for x in (log, np.where(outside, log, 0))),
                 pa.array(each(outside, np.int64) + n_rare), pa.array(model_logs), rare],
                names=["doc_id", "row_key", "n_tokens", "n_head", "head_logs", "outside_logs", "n_outside", "model_log", "rare"])

    passed = materialize(rows.mapInArrow(run, (
        "doc_id long, row_key long, n_tokens long, n_head long, head_logs double, outside_logs double, n_outside long, model_log double, "
        "rare array<struct<word:binary,times:long>>")), "passed")
    # Rows that repeat share their rare words; one of them goes through the join.
    rare = passed.filter(F.size("rare") > 0).groupBy("row_key").agg(F.first("rare").alias("rare")).select("row_key", F.explode("rare").alias("r")).select(
        "row_key", "r.word", "r.times")
    n = F.coalesce("n", F.lit(0))
    tails = rare.join(counts, "word", "left").groupBy("row_key").agg(
        F.sum(F.col("times") * F.log10(n + ALPHA)).alias("tail_logs"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    # A matrix product rounds by a row's place in it; rows that repeat take one of their values.
    tails = passed.groupBy("row_key").agg(F.min("model_log").alias("same_log")).join(tails, "row_key", "left")
    tail_logs = F.coalesce("tail_logs", F.lit(0.0))
    end_log = math.log10(ends + ALPHA)
    return passed.drop("rare").join(tails, "row_key", "left").select(
        "doc_id", "row_key", "n_tokens",
        (F.col("n_head") + F.coalesce("tail_known", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_logs") + tail_logs + end_log - F.col("n_tokens") * base_total).alias("base_score"),
        (F.col("same_log") + F.col("outside_logs") + tail_logs - F.col("n_outside") * rest_total).alias("score"))


def held_out() -> Column:
    return remainder("doc_id", 10) == 0
