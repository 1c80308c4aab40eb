"""The pipeline's stages on a small table against plain Python."""

import os

import pytest
from pyspark.sql import functions as F

from shelfmark.session import fresh_dir


@pytest.fixture(scope="module")
def tables(spark):
    import random

    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    items = [(i, text(40)) for i in range(5)]
    docs = [(i, text(80)) for i in range(120)]
    docs += [(200 + i, "$$$ ### !!! ||| @@@ " * 12 + str(i)) for i in range(40)]           # junk
    docs += [(300 + i, docs[i][1]) for i in range(10)]                                     # exact copies
    docs += [(400 + i, docs[i][1].replace(".", " end.")) for i in range(20, 26)]           # near copies
    docs += [(500 + i, text(30) + " " + t + " " + text(30)) for i, t in items]             # leaks
    docs += [(600 + i, text(50) + f" token = \"{'ab12' * 6}{i}\" " + text(20)) for i in range(4)]
    docs += [(700, None), (701, ""), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "row_key", F.lit("kept as it is")).withColumn("blob", F.lit(1.5))
    sf_dir = fresh_dir(spark, "fixture")
    df.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    spark.createDataFrame([(d, int(not 200 <= d < 300), 0) for d, _ in docs if d % 2], "doc_id long, quality int, toxic int").write.parquet(
        f"{sf_dir}/labels.parquet")
    return sf_dir, dict(docs)


def test_stages(spark, tables):
    import corpus_pipeline as pipeline

    sf_dir, texts = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        path = fresh_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    clean = set(range(120)) | set(range(500, 505)) | set(range(600, 604))
    assert clean <= set(kept[0]) and not set(kept[0]) & set(range(200, 240))
    assert kept[1] == sorted({d for d in kept[0] if not (300 <= d < 310 or 420 <= d < 426)})  # one of each group, 3 once
    assert kept[2] == [d for d in kept[1] if not 500 <= d < 505] and kept[3] == kept[2]
    for r in docs.collect():
        if 600 <= r["doc_id"] < 604:
            assert "ab12" not in r["text"] and "[assign]" in r["text"] and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == texts[r["doc_id"]]
        assert (r["row_key"], r["blob"]) == ("kept as it is", 1.5)
    encoded = {r["doc_id"]: r for r in pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert sorted(encoded) == kept[3] and all(r["exact"] for r in encoded.values())
    assert sorted(r["doc_id"] for r in pipeline.run(spark, sf_dir).select("doc_id").collect()) == kept[3]


def test_empty_documents(spark, tables):
    import corpus_pipeline as pipeline

    sf_dir, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs_ = stage(spark, docs, sf_dir)
        assert docs_.count() == 0


def test_oracle_is_declared():
    import corpus_pipeline as pipeline

    assert pipeline.ORACLE_SQL is None and [len(s) for s in pipeline.STAGES] == [2] * 5
    assert os.path.basename(pipeline.__file__) == "corpus_pipeline.py"
