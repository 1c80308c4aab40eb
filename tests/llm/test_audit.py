import itertools
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import audit

LONG = " ".join(f"w{i}" for i in range(220))
ROWS = [  # doc_id, text, lang
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "de"), (3, "same " * 300, "en"), (4, "", "en"), (5, None, None), (6, "", ""),
    (None, LONG, "fr"), (7, LONG.upper() + " $", "de"), (8, "short & SWEET", "de"), (9, LONG + "\x0b#", "en"), (10, "É" * 300 + " AAAAAAAAAA", "en"),
    (11, "x\ty " * 150, "fr"), (11, "x\ty " * 150, "fr"), (12, LONG, None),
]
LABELS = [(2, 1, 0), (3, 0, 1), (3, None, None), (4, 1, 1), (8, None, 1), (8, 1, 0), (None, 1, 1), (12, 1, 0), (11, 1, 1), (99, 1, 1)]


def brute(rows, labels):
    fails = []
    for i, (doc, text, lang) in enumerate(rows):
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
               "D": any(c in "#$%&*|" for c in t), "E": any(o is not None and doc is not None and o < doc and (s or "") == t for o, s, _ in rows)}
        good = any(d == doc and q == 1 for d, q, _ in labels if d is not None)
        toxic = any(d == doc and x == 1 for d, _, x in labels if d is not None)
        fails.append((lang or "", {k for k, v in own.items() if v}, good, toxic))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                failing = [x for x in mine if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in failing),
                                                   sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def tables(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select(
        "*", F.lit(1).alias("row"), F.lit("x").alias("words"), F.lit("y").alias("part"), F.lit(0).alias("filter"))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def found(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_brute_force(spark):
    assert found(audit.audit(*tables(spark, ROWS, LABELS))) == brute(ROWS, LABELS)


def test_empty_tables_and_no_failures(spark):
    docs, labels = tables(spark, ROWS, LABELS)
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert found(audit.audit(docs, labels.limit(0))) == brute(ROWS, [])
    clean = [(1, LONG, "en")]
    rows = found(audit.audit(*tables(spark, clean, [])))
    assert len(rows) == 600 and set(rows.values()) == {(1, 0, 0, 0, 0, 0, 0)}


def test_many_copies_of_one_text(spark):
    rows = [(i, LONG if i % 3 else f"{LONG} {i}", "en") for i in range(600)]
    assert found(audit.audit(*tables(spark, rows, [(i, 1, i % 2) for i in range(600)]))) == brute(rows, [(i, 1, i % 2) for i in range(600)])


def test_relations_and_other_filters(spark):
    docs, labels = tables(spark, ROWS, LABELS)
    rows = audit.checked(docs, audit.text_filters())
    relations = audit.store_relations(rows, labels)
    per = {r["filter"]: r["count"] for r in relations.groupBy("filter").count().collect()}
    want = {f: v[1] for (p, o, s), v in brute([(d, t, "x") for d, t, _ in ROWS], []).items() if s == 1 for f in o[0]}
    assert per == {f: n for f, n in want.items() if n}
    short = audit.audit(docs, labels, {"S": F.char_length("text") < 20, "L": F.char_length("text") > 1000}, copies=None)
    assert {r["filter_order"] for r in short.collect()} == {"SL", "LS"}
    with pytest.raises(ValueError):
        audit.audit(docs, labels, {"SS": F.lit(True)})
