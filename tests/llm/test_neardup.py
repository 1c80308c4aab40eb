import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import neardup
from shelfmark.llm.common import Cached, texts, without
from shelfmark.llm.components import connected_components
from shelfmark.session import fresh_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, k, percent):
    sets = []
    for _, text in docs:
        w = WORD.findall((text or "").lower())
        n = min(k, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set())
    label = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
                    changed = True
    least = {}
    for (d, _), c in zip(docs, label):
        least[c] = min(d, least.get(c, d))
    return sorted((d, len(s), least[c], d == least[c]) for (d, _), s, c in zip(docs, sets, label))


def found(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("keys", F.lit(1))
    rows = neardup.near_duplicates(df, **options).collect()
    return rows, sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("tile", [2048, 5])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "X"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    base, other = text(150), text(120)
    docs = [text(rng.choice([1, 2, 3, 10, 80])) for _ in range(25)]
    docs += [edited(base, rng.choice([0, 1, 2, 4, 7, 9, 12])) for _ in range(40)]  # linked, chained and unlinked copies
    docs += [edited(other, i) for i in range(5)] + [other[:60] + base[:60], ["one"], ["one"], ["One", "two"]]
    rows = [(100 - i, " ".join(w)) for i, w in enumerate(docs)] + [(1000, None), (1001, ""), (1002, " \n "), (1003, "")]
    _, got = found(spark, rows, shingle=3, percent=85, band_rows=7)
    assert got == brute(rows, 3, 85)


def test_repeated_ids_and_empty(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows, got = found(spark, [(1, a), (1, b), (2, b), (3, a), (3, a), (None, a), (None, None), (1, "")])
    assert len(rows) == 8
    assert sum(r["chosen"] for r in rows if r["n_shingles"]) == 2  # one text of either group
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert found(spark, [])[1] == []


def test_signature_is_superminhash():
    """The vectorised signature against the definition, element by element."""
    rng = np.random.default_rng(0)
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    for size in (1, 2, 9, 200):
        items, places = rng.integers(0, 2**63, size).astype(np.uint64), 24
        want = [float("inf")] * places
        for h in items.tolist():
            order = list(range(places))
            for j in range(places):
                u = mixed(h + (j + 1) * 0x9E3779B97F4A7C15 & mask)
                k = j + mixed(u) % (places - j)
                order[j], order[k] = order[k], order[j]
                want[order[j]] = min(want[order[j]], j + (u >> 11) * 2.0 ** -53)
        assert neardup.signatures([items], places)[0].tolist() == want
    parts = neardup._signed([items], 24, 50)
    assert parts[0].tolist() == want  # a large set in parts


def test_agreement_estimates_similarity():
    ids = Cached(xxhash.xxh64_intdigest)
    a = neardup.shingles(" ".join(f"x{i}" for i in range(1000)).encode(), 3, ids)
    b = neardup.shingles(" ".join(f"x{i}" for i in range(100, 1100)).encode(), 3, ids)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    s = neardup.signatures([a, b], 512)
    assert abs((s[0] == s[1]).mean() - true) < 0.06
    assert neardup.bands(85, 7) == 42


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (41, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {41} and got[200] == got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_in_no_pair_are_left_out_before_the_shuffle(spark):
    from shelfmark.llm import neardup

    sets = spark.createDataFrame([(i, 4, [1, 2, 3, 4 + i // 2]) for i in range(8)], "id long, size int, items array<long>")
    pairs = spark.createDataFrame([(0, 1), (2, 5), (4, 5)], "a long, b long")
    found = neardup._linked(pairs, sets, 80)
    assert sorted(map(tuple, found.collect())) == [(0, 1), (4, 5)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_that_stay_are_not_shuffled(spark):
    path = fresh_dir(spark, "docs")
    spark.createDataFrame([(i if i % 7 else None, f"text {i} " * 400) for i in range(400)] + [(1, None), (2, "")], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    rows = texts(docs).filter("doc_id % 20 = 0 OR doc_id IS NULL OR text = ''").select("doc_id", "row_key")
    left = without(docs, rows.unionAll(rows))
    want = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] % 20 and r["text"])
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == want
    assert "ArrowEvalPython" in left._jdf.queryExecution().toString()
