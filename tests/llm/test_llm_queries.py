"""The registered pipeline queries against their SQL twins, and the rows they return."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "embeddings", "labels")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [
    "op2_ball_tree", "op3_decontaminate", "op5_superminhash", "op7_secret_scan", "op11_pii", "op12_ranked_search", "op13_filter_audit"])
def test_query_equals_sql(spark, duck, name):
    from shelfmark.llm.oracles import ORACLES
    from shelfmark.llm.queries import QUERIES

    df = QUERIES[name](spark, SF_DIR)
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, cur.fetchall())) == sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_entry_registers_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n[:2] == "op" and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names


@pytest.mark.parametrize("name,score", [("op6_toxicity", 0.9), ("op10_quality", 0.9)])
def test_held_out_accuracy(spark, name, score):
    from shelfmark.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    label = {"op6_toxicity": "toxic", "op10_quality": "quality"}[name]
    found = QUERIES[name](spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = found[found.held_out].merge(labels, on="doc_id")
    assert len(found) == 1000 and found.score.between(0, 1).all()
    assert (both.predicted == both[label]).mean() >= score
    # Clean documents are left alone.
    clean = both[both[label] == (0 if label == "toxic" else 1)]
    assert (clean.predicted == clean[label]).mean() >= 0.97


def test_language_held_out(spark):
    from shelfmark.llm.queries import QUERIES

    found = QUERIES["op4_language"](spark, SF_DIR).toPandas()
    langs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found[found.held_out].merge(langs, on="doc_id")
    assert len(found) == 200 and (both.lang == both.lang_pred).mean() > 0.95
