import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    counted = [(d, terms(t)) for d, t in docs]
    n = sum(bool(w) for _, w in counted)
    total = sum(len(w) for _, w in counted)
    df = Counter(t for _, w in counted for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        scores = []
        for doc, w in counted:
            tf, score = Counter(w), 0
            for t in terms(text):
                if tf[t]:
                    score += weight[t] * (1000000000 * tf[t] // (1000 * tf[t] + 12 * (100 - 25 + 25 * len(w) * n // total)))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(scores, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k, parts=6, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).select("*", F.lit(1).alias("shard"), F.lit("x").alias("term"))
    i = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(2).alias("item"), F.lit(3).alias("rank"))
    return sorted((tuple(r) for r in ranked.search(d, i, k, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    """Common words in most documents, rarer and rarer others, copies, and documents that hold whole items."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "straße", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda m: " ".join(rng.choices(vocabulary, weights, k=m))
    items = [(i, text(rng.randrange(1, 25)).upper() + ", the; " + rng.choice(vocabulary)) for i in range(12)]
    docs = [(i, text(rng.randrange(0, 60)) + (" " + items[i % 12][1] if i % 17 == 0 else "")) for i in range(n)]
    return docs + [(n + i, docs[7][1]) for i in range(30)], items


@pytest.mark.parametrize("seed,n,k", [(1, 400, 3), (2, 150, 20), (3, 700, 1)])
def test_equals_brute_force(spark, seed, n, k):
    docs, items = corpus(seed, n)
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_owners_do_not_matter(spark):
    docs, items = corpus(4, 200)
    want = brute(docs, items, 2)
    for owners in ((), (0.5,), (0.005, 0.02, 0.05, 0.2, 0.6)):
        assert run(spark, docs, items, 2, owners=owners) == want


def test_nulls_ties_repeats_and_long_texts(spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (0, "ALPHA beta"), (2, None), (3, ""), (4, "... !"), (5, "beta " * 400_000 + "x" * 3_000_000 + " alpha"),
            (6, "gamma"), (7, "Alpha alpha alpha")]
    items = [(1, "alpha alpha Beta"), (1, "gamma"), (2, None), (3, "nowhere"), (None, "beta;beta"), (4, "")]
    assert run(spark, docs, items, 4, 3) == brute(docs, items, 4)


def test_empty_tables(spark):
    docs, items = corpus(5, 20)
    assert run(spark, [], items, 3) == [] and run(spark, docs, [], 3) == [] and run(spark, [(1, "...")], items, 3) == []


def test_bundles_leave_out_what_cannot_win(spark):
    """With one document far ahead, the stages of common words take in nothing new."""
    import numpy as np
    import pyarrow as pa

    n = 500
    corpus_ = ranked.Corpus(n, n * 10)
    weighted = pa.table({"item": [0, 0], "term": [b"rare", b"common"], "times": [5, 1], "owner": [0, 1], "weight": [5000, 1]})
    block = ranked.Block.of(weighted, 2)
    head = {"shard": 0, "term": None, "docs": None, "tfs": None, "ids": list(range(n)), "lengths": [10] * n}
    rare = head | {"term": b"rare", "docs": np.array([3], np.int32).tobytes(), "tfs": np.array([2], np.int64).tobytes(), "ids": None, "lengths": None}
    common = rare | {"term": b"common", "docs": np.arange(n, dtype=np.int32).tobytes(), "tfs": np.ones(n, np.int64).tobytes()}
    empty = ranked._BUNDLE_SCHEMA.empty_table()
    first = ranked._stage(empty, pa.Table.from_pylist([rare, head]), block, 0, np.zeros(1, np.int64), corpus_, 1)
    assert first.num_rows == 1
    floor = np.array([first["top"][0].as_py()[0]])
    last = ranked._stage(first, pa.Table.from_pylist([head, common]), block, 1, floor, corpus_, 1)
    assert [b["doc_id"] for b in last["best"][0].as_py()] == [3]
    scores = np.frombuffer(first["scores"][0].as_py(), np.int64)
    assert last["best"][0].as_py()[0]["score"] > scores[0] and len(scores) == 1
