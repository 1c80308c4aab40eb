import random
import re

from pyspark.sql import functions as F

from shelfmark.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s:s + n]))
                if found:
                    hit.update(range(s, s + n))
                    ids |= found
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("row_key", F.lit(2))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x")).withColumn("words", F.lit(0))
    found = decontam.contamination(d, b).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "Ä", "x1", "éa", "w"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 30]))) for i in range(12)] + [(20, ""), (21, None), (7, "Solo"), (2, text(12))]
    docs = [(i, text(rng.choice([0, 2, 9, 10, 40, 200]))) for i in range(30)]
    docs += [(100 + i, text(5) + " " + (t or "").upper().replace("É", "é").replace("Ä", "Ä") + ", " + text(7)) for i, t in items]
    docs += [(200, None), (201, ""), (202, "solo"), (3, docs[3][1]), (4, "another text of the same id")]
    assert run(spark, docs, items) == brute(docs, items)


def test_long_text_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(1, " ".join(f"w{i}" for i in range(60_000)) + " " + passage)]
    assert run(spark, docs, [(5, passage), (None, passage)]) == [(1, 60_040, 40, ["5"])]
    assert run(spark, docs, []) == [(1, 60_040, 0, [])]
    assert run(spark, [], [(5, passage)]) == []
