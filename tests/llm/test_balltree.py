import math
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import balltree


def brute(rows, k, queries):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % queries == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in ok if c != q and len(w) == len(v))
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, k, queries, shard_rows, leaf, block):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).select(
        "vec_id", balltree.integral(F.col("embedding")).alias("v"))
    asked = df.filter(F.col("vec_id") % queries == 0).withColumnRenamed("vec_id", "query_id")
    found = balltree.search(balltree.build_index(df, shard_rows, leaf), asked, k, block)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vector = lambda d, scale=1.0: [round(rng.uniform(-scale, scale), 2) for _ in range(d)]
    rows = [(i, vector(6)) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, []), (402, [float("nan")] * 6), (403, [None] + [0.0] * 5), (405, [float("inf")] + [0.0] * 5)]
    rows += [(410 + i, vector(3, 40)) for i in range(20)]  # another length
    rows = [(i, v and [None if x is None else float.fromhex(float(x).hex()) for x in v]) for i, v in rows]
    import numpy as np
    as_float = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows, 5, 5, 64, 8, 32) == brute(as_float, 5, 5)


def test_rows_without_an_id_take_no_part(spark):
    rows = [(None, [9.0, 9.0]), (0, [1.0, 0.5]), (None, None), (1, [0.5, 0.5]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", balltree.integral(F.col("embedding")).alias("v"))
    found = balltree.search(balltree.build_index(df), df.withColumnRenamed("vec_id", "query_id"), 5).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in found) == [(0, 1), (1, 0)]


def test_few_rows_and_empty(spark):
    assert run(spark, [(0, [1.0, 0.5]), (1, [0.5, 0.5])], 5, 1, 10, 4, 16) == [(0, 1, 1, 256 * 128 + 128 * 128), (1, 1, 0, 256 * 128 + 128 * 128)]
    assert run(spark, [(0, [1.0])], 5, 1, 10, 4, 16) == []
    assert run(spark, [], 5, 1, 10, 4, 16) == []


@pytest.mark.parametrize("size", [1e6, 1e15])
def test_large_components_stay_exact(spark, size):
    rows = [(i, [float(size * (i + 1)), float(i)]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", balltree.integral(F.col("embedding")).alias("v"))
    found = balltree.search(balltree.build_index(df), df.withColumnRenamed("vec_id", "query_id"), 3).collect()
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for r in found:
        exact = sum(a * b for a, b in zip(whole[r["query_id"]], whole[r["vec_id"]]))
        assert r["score"] == max(-2**63, min(2**63 - 1, exact))
