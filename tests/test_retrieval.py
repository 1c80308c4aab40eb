"""Ranking operators against brute force and the worked examples."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions.vectors import cosine, nearest_rank
from shelfmark.operators import evaluation, planning, ranking, telemetry, vector_search


def cos(a, b):
    m = min(len(a), len(b))
    a, b = np.asarray(a[:m], float), np.asarray(b[:m], float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return 0.0 if n == 0 else float(a @ b / n)


def brute(questions, chunks, k):
    want = {}
    for q in questions:
        limit = q.get("k", k) if q.get("k", k) is not None else k
        scored = sorted(
            ((-round(cos(q["v"], c["v"]), 9), c["id"]) for c in chunks
             if q.get("scope") is None or q["scope"] == c["doc"]))
        want[q["id"]] = [cid for _, cid in scored[:limit]]
    return want


def frames(spark, questions, chunks):
    cols = [c for c in ("k", "scope") if c in questions[0]]
    q = spark.createDataFrame([(x["id"], x["v"], *[x[c] for c in cols]) for x in questions],
                              "query_id long, embedding array<float>" + "".join(f", {c} {'int' if c == 'k' else 'string'}" for c in cols))
    c = spark.createDataFrame([(x["id"], x["doc"], x["v"]) for x in chunks], "chunk_id string, doc_id string, embedding array<float>")
    return q, c.repartition(5)


def got(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["chunk_id"])
    return out


def cloud(seed=1, n=300, q=12, dims=(8,)):
    rnd = random.Random(seed)
    vec = lambda: [float(rnd.randint(-2, 2)) for _ in range(rnd.choice(dims))]
    chunks = [{"id": f"c{i:04d}", "doc": f"d{min(i % 7, 3)}", "v": vec()} for i in range(n)]
    # A third of the store is one vector under many ids.
    for c in chunks[::3]:
        c["v"] = [1.0] * dims[0]
    chunks[1]["v"] = [0.0] * dims[0]
    return [{"id": i, "v": vec()} for i in range(q)], chunks


@pytest.mark.parametrize("dims", [(8,), (8, 5, 3)])
def test_knn_equals_brute_force(spark, dims):
    questions, chunks = cloud(dims=dims)
    q, c = frames(spark, questions, chunks)
    want = brute(questions, chunks, 7)
    assert got(vector_search.knn(q, c, 7)) == want
    tiled = vector_search.knn(q, c, 7, max_block_rows=5, tile_rows=70)
    assert got(tiled) == want


def test_knn_with_scope_and_own_limits(spark):
    questions, chunks = cloud(seed=3)
    for i, x in enumerate(questions):
        x["scope"] = [None, "d0", "d3", "unknown"][i % 4]
        x["k"] = [None, 0, 2, 9][(i // 2) % 4]
    q, c = frames(spark, questions, chunks)
    want = {k: v for k, v in brute(questions, chunks, 5).items() if v}
    assert got(vector_search.knn(q, c, 5)) == want
    assert got(vector_search.knn(q, c, 5, max_block_rows=4, tile_rows=90)) == want


def test_knn_without_hits(spark):
    questions, chunks = cloud(n=4, q=1)
    q, c = frames(spark, questions, chunks)
    assert vector_search.knn(q, c, 0).count() == 0
    assert vector_search.knn(q, c.limit(0), 3).count() == 0
    assert got(vector_search.knn(q, c, 9))[0] == brute(questions, chunks, 9)[0]
    one = vector_search.knn_one(questions[0]["v"], c, 3).collect()
    assert [r["chunk_id"] for r in one] == brute(questions, chunks, 3)[0]


@pytest.mark.parametrize("k, want", [(0, 0), (-3, 0), (1, 4), (2, 8), (64, 256), (100, 256), (256, 256), (257, 257), (300, 300)])
def test_fetch_size(k, want):
    assert vector_search.fetch_size(k) == want


def test_pairwise_distance(spark):
    _, chunks = cloud(seed=5, n=60)
    _, c = frames(spark, [{"id": 0, "v": [1.0]}], chunks)
    pairs = sorted((round(1 - round(cos(a["v"], b["v"]), 9), 9), a["id"], b["id"])
                   for a in chunks for b in chunks if a["id"] < b["id"])[:15]
    rows = [(r["distance"], r["chunk_a"], r["chunk_b"]) for r in vector_search.pairwise_distance(c, 15, tile_rows=17).collect()]
    assert rows == pairs


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0, 9.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(F.round(cosine(F.col("a"), F.col("b")), 9)).collect()] == [0.0, 1.0]


def test_index_recall_full_probe_and_insertion(spark):
    from shelfmark.operators.ann import VectorIndex, recall
    from shelfmark.session import fresh_dir

    rnd = np.random.default_rng(9)
    around = rnd.normal(size=(12, 24))
    vectors = [(around[i % 12] + rnd.normal(size=24) * 0.4).tolist() for i in range(1500)]
    # A third of the rows are one vector; one has no length.
    vectors[::3], vectors[1] = [vectors[0]] * 500, [0.0] * 24
    chunks = [{"id": f"c{i:04d}", "doc": "d", "v": v} for i, v in enumerate(vectors)]
    questions = [{"id": i, "v": (around[i % 12] + rnd.normal(size=24) * 0.5).tolist()} for i in range(40)]
    q, c = frames(spark, questions, chunks)
    index = VectorIndex(spark, fresh_dir(spark, "vectors"))
    index.fit(c.filter("chunk_id < 'c0900'"), 16)
    index.insert(c.filter("chunk_id < 'c0900'"))
    fitted = index.quantiser().centres.tolist()
    index.insert(c.filter("chunk_id >= 'c0900'"))
    assert index.quantiser().centres.tolist() == fitted and index.rows().count() == 1500
    exact = brute(questions, chunks, 10)
    assert got(index.search(q, 10, nprobe=16, refine=None)) == exact
    assert got(index.search(q, 10, nprobe=16, refine=None, block_rows=7)) == exact
    near = index.search(q, 10, nprobe=4)
    assert recall(near, vector_search.knn(q, c, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    plan = VectorIndex(spark, index.path).search(q.limit(1), 10, nprobe=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan


def test_exact_index_search_reads_vectors_only(spark):
    """Products of the vectors decide alone: no codes are read, and copies fall to the lower id."""
    from shelfmark.operators.ann import VectorIndex
    from shelfmark.session import fresh_dir

    rnd = np.random.default_rng(4)
    around = rnd.normal(size=(6, 20))
    vectors = np.concatenate([around[np.arange(900) % 6] + rnd.normal(size=(900, 20)) * 0.5, np.tile(around[:1], (300, 1))])
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, embedding array<double>")
    index = VectorIndex(spark, fresh_dir(spark, "vectors"))
    index.fit(c, 6)
    index.insert(c)
    asked = c.filter("chunk_id % 40 = 0").withColumnRenamed("chunk_id", "query_id")
    whole = index.search(asked, 5, nprobe=6, refine=None, block_rows=9)
    assert got(whole) == got(vector_search.knn(asked, c, 5))
    scans = [line for line in whole._jdf.queryExecution().toString().splitlines() if "ReadSchema" in line]
    assert scans and not any("codes" in line for line in scans)
    # With fewer cells probed it is exact within these.
    held, centres = index.rows().select("chunk_id", "embedding", "cell").toArrow(), index.quantiser().centres
    ids, cells = held["chunk_id"].to_numpy(), held["cell"].to_numpy()
    rows = np.array(held["embedding"].to_pylist())
    rows, expected = rows / np.linalg.norm(rows, axis=1, keepdims=True), {}
    for number, vector in asked.collect():
        unit = np.array(vector) / np.linalg.norm(vector)
        near = np.argsort(((centres - unit) ** 2).sum(1))[:2]
        own = np.flatnonzero(np.isin(cells, near))
        expected[number] = ids[own[np.lexsort((ids[own], -np.round(rows[own] @ unit, 9)))[:5]]].tolist()
    assert got(index.search(asked, 5, nprobe=2, refine=None, block_rows=9)) == expected


def test_places_that_reach_their_rows_least():
    rnd = np.random.default_rng(1)
    for n, width in ((0, 8), (3, 0), (1, 1), (5, 7), (4, 8), (3, 1001)):
        scores, least = rnd.random((n, width), dtype=np.float32), rnd.random(n, dtype=np.float32)
        scores[:, ::5] = np.nan
        places = vector_search._reaching(scores, least)
        assert [p.tolist() for p in places] == [p.tolist() for p in np.nonzero(scores >= least[:, None])]


def test_index_with_few_rows_and_other_lengths(spark):
    from shelfmark.operators.ann import VectorIndex
    from shelfmark.session import fresh_dir

    q, c = frames(spark, [{"id": 1, "v": [1.0, 0.0, 2.0]}], [{"id": "a", "doc": "d", "v": [1.0, 0.0, 2.0]}, {"id": "b", "doc": "d", "v": [0.0, 1.0, 0.0]}])
    index = VectorIndex(spark, fresh_dir(spark, "vectors"))
    index.fit(c, 8)
    index.insert(c)
    assert got(index.search(q, 5, nprobe=8)) == {1: ["a", "b"]}
    assert index.search(q.limit(0), 5, nprobe=8).count() == 0
    with pytest.raises(Exception, match="3 dimensions"):
        index.insert(spark.createDataFrame([("x", [1.0])], "chunk_id string, embedding array<float>"))
    with pytest.raises(ValueError):
        index.fit(c.limit(0), 2)


def test_dedup_keeps_best_of_equal_texts(spark):
    hits = spark.createDataFrame([
        (1, "c1", "Kafka Streams", 1), (1, "c2", "  kafka   streams ", 2), (1, "c3", "other", 3), (1, "c4", None, 4),
        (1, "c5", " ", 5), (1, "c6", "last", 6)], "query_id int, chunk_id string, content string, rank int")
    rows = ranking.dedup_hits(hits, 3).orderBy("rank").collect()
    assert [(r["chunk_id"], r["rank"]) for r in rows] == [("c1", 1), ("c3", 2), ("c4", 3)]


def bm25_model(query, texts):
    import regex

    toks = [regex.findall(r"[\p{L}\p{N}']+", (t or "").lower()) for t in texts]
    avg = sum(map(len, toks)) / len(toks)
    out = []
    for doc in toks:
        score = 0.0
        for term in set(regex.findall(r"[\p{L}\p{N}']+", query.lower())):
            tf, df = doc.count(term), sum(term in d for d in toks)
            if tf:
                idf = math.log(1 + (len(toks) - df + .5) / (df + .5))
                score += idf * (tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(doc) / avg)) + .5)
        out.append(score)
    return out


def test_bm25(spark):
    sets = {1: ("cobalt conductor", ["cobalt conductor here", "cobalt cobalt cobalt", "nothing", None, "Ünïcode conductor's"]),
            2: ("", ["a b"]), 3: ("don't stop, don't", ["don't", "stop stop", "go"])}
    cands = spark.createDataFrame(
        [(q, f"{q}-{i}", t, {"m": "x"}) for q, (_, ts) in sets.items() for i, t in enumerate(ts)],
        "query_id int, chunk_id string, content string, metadata map<string,string>")
    asked = spark.createDataFrame([(q, t) for q, (t, _) in sets.items()], "query_id int, question string")
    rows = {r["chunk_id"]: r for r in ranking.bm25(cands, asked).collect()}
    assert len(rows) == 9
    for q, (text, docs) in sets.items():
        for i, want in enumerate(bm25_model(text, docs)):
            assert rows[f"{q}-{i}"]["bm25"] == pytest.approx(want, abs=1e-8)
    assert rows["1-0"]["metadata"] == {"m": "x"} and rows["1-3"]["content"] is None


def test_fuse_promotes_lexical_match_and_skips_small_sets(spark):
    texts = ["alpha beta", "zebra zebra", "gamma delta", "omega"]
    cands = spark.createDataFrame([(1, f"c{i}", t, i + 1) for i, t in enumerate(texts)] + [(2, "d0", "no", 1), (2, "d1", "zebra", 2)],
                                  "query_id int, chunk_id string, content string, rank int")
    asked = spark.createDataFrame([(1, "zebra"), (2, "zebra")], "query_id int, question string")
    rows = ranking.fuse(cands, asked, 2).orderBy("query_id", "rank").collect()
    # Fused: c1 is second by vector and first by words; c0 first by vector, second by words.
    assert [(r["query_id"], r["chunk_id"], r["fused"]) for r in rows] == [
        (1, "c0", True), (1, "c1", True), (2, "d0", False), (2, "d1", False)]
    top = ranking.fuse(cands.filter("chunk_id != 'c0' or query_id != 1"), asked, 1).filter("query_id = 1").first()
    assert top["chunk_id"] == "c1"


def test_metadata_filter(spark):
    hits = spark.createDataFrame([("a", {"source": "web"}, 0, "d1", {"source": "web"}), ("b", {"source": "file"}, 1, "d1", {"documentId": "d1", "chunkIndex": "1"}),
                                  ("c", {}, 2, "d2", None)],
                                 "chunk_id string, metadata map<string,string>, chunk_index int, doc_id string, f map<string,string>")
    ids = lambda df: [r["chunk_id"] for r in df.orderBy("chunk_id").collect()]
    assert ids(ranking.metadata_filter(hits, {"source": "web"})) == ["a"]
    assert ids(ranking.metadata_filter(hits, {})) == ["a", "b", "c"]
    assert ids(ranking.metadata_filter(hits, {"documentId": "d1", "chunkIndex": 1})) == ["b"]
    assert ids(ranking.metadata_filter(hits, "f")) == ["a", "b", "c"]


@pytest.mark.parametrize("question, want", [
    ("chunk and embed and retrieve", ["chunk", "embed", "retrieve"]), ("what?what", ["what"]), ("  ", []), (None, []),
    ("a then and b", ["a then", "b"]), ("first; second;third. Why", ["first", "second", "third", "Why"])])
def test_subqueries(value, question, want):
    assert value([question], planning.subqueries(F.col("t")))[0] == want


def test_plan_steps_repeat_the_last_part(spark):
    q = spark.createDataFrame([(1, "a and b"), (2, "")], "query_id int, question string")
    rows = [(r["query_id"], r["step"], r["subquery"]) for r in planning.plan_steps(q).orderBy("query_id", "step").collect()]
    assert rows == [(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (2, 0, ""), (2, 1, ""), (2, 2, "")]


def test_context(spark):
    q = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id int, question string")
    hits = spark.createDataFrame([(1, "second", 2), (1, "first", 1)], "query_id int, content string, rank int")
    rows = {r["query_id"]: r for r in ranking.build_context(hits, q).collect()}
    assert rows[1]["context"] == "first\n---\nsecond" and rows[2]["context"] == "(no context retrieved)"
    assert rows[1]["prompt"] == ranking.PROMPT.replace("%1$s", "first\n---\nsecond").replace("%2$s", "q1")
    own = ranking.build_context(hits, q, "%2$s <- %1$s").filter("query_id = 2").first()
    assert own["prompt"] == "q2 <- (no context retrieved)"


def test_check_embeddings(spark):
    good = spark.createDataFrame([("a", [1.0]), ("b", [1.0]), ("c", [1.0, 2.0])], "chunk_id string, embedding array<float>")
    assert {tuple(r) for r in vector_search.check_embeddings(good).collect()} == {(1, 2), (2, 1)}
    bad = spark.createDataFrame([("a", None)], "chunk_id string, embedding array<float>")
    with pytest.raises(Exception, match="has no embedding"):
        vector_search.check_embeddings(bad).collect()


def test_nearest_rank_and_exact_percentiles(spark):
    rnd = random.Random(4)
    values = {"a": [rnd.random() for _ in range(5000)], "b": [1.0] * 900 + [2.0, 3.0], None: [7.0], "c": [float(i % 10) for i in range(57)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    asked = {"p1": 1.0, "p50": 50.0, "p95": 95.0, "p100": 100.0}
    for r in telemetry.exact_percentiles(df, ["k"], "v", asked).collect():
        vs = sorted(values[r["k"]])
        for name, p in asked.items():
            assert r[name] == vs[max(1, math.ceil(p / 100 * len(vs))) - 1], (r["k"], name)
    arr = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>")
    assert arr.select(nearest_rank(F.col("a"), 50.0)).first()[0] == 2.0


def test_evaluation(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "query_id int, label string")
    items = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "chunk_id string, label string")
    hits = spark.createDataFrame([(1, "c", 1), (1, "a", 2), (2, "a", 1)], "query_id int, chunk_id string, rank int")
    judged = evaluation.judge(hits, q, items)
    rows = {r["query_id"]: r for r in evaluation.precision_recall(judged, 2).collect()}
    assert (rows[1]["precision_at_k"], rows[1]["recall_at_k"], rows[1]["reciprocal_rank"]) == (0.5, 0.5, 0.5)
    assert (rows[2]["precision_at_k"], rows[3]["recall_at_k"]) == (0.0, 0.0)
    assert evaluation.mrr(judged).first()["mrr"] == round(0.5 / 3, 6)


def test_keyword_search(spark):
    c = spark.createDataFrame([("a", "d", 0, "x Machine Learning", [1.0, 0.0]), ("b", "d", 1, "none", [1.0, 0.0]),
                               ("c", "d", 2, "machine learning too", [0.0, 1.0]), ("e", "d", 3, "MACHINE LEARNING", [1.0, 0.1])],
                              "chunk_id string, doc_id string, chunk_index int, content string, embedding array<float>")
    assert [r["chunk_id"] for r in vector_search.search_with_keyword(c, "machine learning", 2).collect()] == ["a", "e"]
    assert vector_search.search_with_keyword(c, "50%", 2).count() == 0


def test_corpus_bm25_equals_brute_force(spark):
    import math
    import re
    from collections import Counter

    from shelfmark.operators.lexical_index import build_lexical_index, lexical_search
    from shelfmark.session import fresh_dir

    texts = ["red fox runs", "the red red fox", "a dog", "", None, "dog dog fox Fox", "the the the"]
    path = fresh_dir(spark, "lexical")
    build_lexical_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string"), path)
    asked = [(1, "Red fox"), (2, "the dog the"), (3, "absent"), (4, None)]
    got = lexical_search(spark, path, spark.createDataFrame(asked, "query_id long, question string"), 3, full=4).collect()
    split = lambda t: re.findall(r"[\w']+", (t or "").lower())
    words = [split(t) for t in texts]
    n, mean = len(texts), sum(map(len, words)) / len(texts)
    df = Counter(w for ws in words for w in set(ws))
    want = []
    for q, question in asked:
        scores = []
        for i, ws in enumerate(words):
            tf = Counter(ws)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) + 0.5)
                    for t in set(split(question)) if tf[t])
            if s:
                scores.append((-round(s, 9), i))
        want += [(q, i, r) for r, (_, i) in enumerate(sorted(scores)[:3], 1)]
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in got) == sorted(want)


def test_lexical_index_skips_what_cannot_win(spark):
    """Stop words fill the corpus; a search reads few of their postings and finds what a full search finds."""
    import math
    from collections import Counter

    from shelfmark.operators.lexical_index import build_lexical_index, lexical_search, search_depths
    from shelfmark.session import fresh_dir

    rnd = random.Random(8)
    common, rare = ["the", "of", "and", "in"], [f"r{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(common, [8, 4, 3, 1], k=rnd.randint(3, 60)) + rnd.choices(rare, k=rnd.randint(0, 30))) for _ in range(3000)]
    path = fresh_dir(spark, "lexical")
    build_lexical_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").repartition(5), path)
    asked = [(1, "the"), (2, "the of and"), (3, "the r7 of"), (4, "r1 r2 r3 r4"), (5, "in"), (6, "unknown the")]
    questions = spark.createDataFrame(asked, "query_id long, question string")
    got = lexical_search(spark, path, questions, 10, full=0).collect()
    assert sorted(got) == sorted(lexical_search(spark, path, questions, 10).collect())
    words = [t.split() for t in texts]
    counts, df = [Counter(w) for w in words], Counter(w for ws in words for w in set(ws))
    mean, want = sum(map(len, words)) / len(words), []
    for q, question in asked:
        scores = []
        for i, tf in enumerate(counts):
            s = sum(math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * (tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) + 0.5)
                    for t in question.split() if tf[t])
            if s:
                scores.append((-round(s, 9), i))
        want += [(q, i, r) for r, (_, i) in enumerate(sorted(scores)[:10], 1)]
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in got) == sorted(want)
    shares = {r["query_id"]: r["s"] for r in search_depths(spark, path, questions, 10, full=0).groupBy("query_id").agg(
        (F.sum("n_read") / F.sum("n")).alias("s")).collect()}
    assert shares[1] < 0.2 and shares[6] < 0.2 and shares[3] < 0.2, shares


def test_lexical_index_without_texts(spark):
    from shelfmark.operators.lexical_index import build_lexical_index, lexical_search
    from shelfmark.session import fresh_dir

    path = fresh_dir(spark, "lexical")
    build_lexical_index(spark.createDataFrame([], "chunk_id long, content string"), path)
    assert lexical_search(spark, path, spark.createDataFrame([(1, "the")], "query_id long, question string"), 3).count() == 0


def test_block_of_questions_sent_to_tasks_is_small(spark, monkeypatch):
    """Workers keep every block they were sent; one must not hold products with all codes."""
    import pickle

    from shelfmark.operators.ann import VectorIndex
    from shelfmark.session import fresh_dir

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 32)))]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    index = VectorIndex(spark, fresh_dir(spark, "vectors"))
    index.fit(df, 4)
    index.insert(df)
    sizes, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: sizes.append(len(pickle.dumps(v))) or send(v))
    asked = df.withColumnRenamed("chunk_id", "query_id")
    found = index.search(asked, 3, nprobe=4, refine=None, block_rows=200)
    assert got(found) == got(vector_search.knn(asked, df, 3))
    assert max(sizes) < 400 * 32 * 8 + 400 * 100


def test_many_copies_in_blocks_and_tiles(spark):
    """Equal scores fall to the lower id, however rows are cut."""
    rows = [(i, [1.0, float(i % 3), 0.5], i % 2) for i in range(300)] + [(300 + i, [0.0, 0.0, 0.0], 1) for i in range(5)]
    c = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, doc_id long")
    q = c.filter("chunk_id % 30 = 0 or chunk_id > 302").selectExpr("chunk_id AS query_id", "embedding", "if(chunk_id % 60 = 0, doc_id, null) AS scope")
    whole = got(vector_search.knn(q, c, 4))
    assert got(vector_search.knn(q, c, 4, max_block_rows=2, tile_rows=50)) == whole
    zero = sorted(r[1] for r in vector_search.knn(q, c, 4).filter("query_id = 304").select("query_id", "chunk_id").collect())
    assert zero == [0, 1, 2, 3]
    pairs = [tuple(r) for r in vector_search.pairwise_distance(c, 5, tile_rows=40).collect()]
    assert pairs == [(0, 3 * i, 0.0) for i in range(1, 6)]
