"""Registered queries against their SQL twins at the smallest scale.

A sample runs by default; set ``ORACLES=all`` for every query.
"""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SAMPLE = ("chunk_fixed", "chunk_recursive", "chunk_semantic", "group_sections", "group_json", "knn", "hybrid_search",
          "multi_step_search", "build_context", "select_family", "expand_sitemaps", "discover", "window_percentiles", "stream_sessions",
          "structural_order", "crawl_bfs", "bm25_corpus", "ivf_full_probe", "pack_lines",
          "document_openings", "robots_allows", "variant_store", "stream_sliding_percentiles")


def names():
    from shelfmark.plans.oracles import ORACLES

    return list(ORACLES) if os.environ.get("ORACLES") == "all" else [n for n in SAMPLE if n in ORACLES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    from shelfmark.plans.oracles import ORACLES
    from shelfmark.plans.queries import QUERIES

    df = QUERIES[name](spark, SF_DIR)
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    from shelfmark.plans.oracles import ORACLES
    from shelfmark.plans.queries import QUERIES

    assert set(ORACLES) <= set(QUERIES)
