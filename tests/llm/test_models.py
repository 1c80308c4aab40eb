"""Language identification, toxicity, language-model and quality models on small inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfmark.llm import langid, lm, quality, toxicity


def held(i, n, r):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n == r


# Language identification

def test_code_lengths_equal_a_plain_model():
    rng = random.Random(4)
    train = {"aa": "abracadabra abba " * 20, "bb": "".join(rng.choice("abcdé \n") for _ in range(300))}
    order, grams = 3, Counter()
    for lang, text in train.items():
        grams.update((lang, int(k)) for k in langid._keys(langid._lowered(text), order))
    keys = list(grams)
    model = langid.Model(sorted(train), np.array([k for _, k in keys], np.int64), np.array([sorted(train).index(lang) for lang, _ in keys]),
                         np.array([grams[k] for k in keys], float), order)

    def plain(lang, text):
        counts = [Counter() for _ in range(order + 1)]
        data = b"\n" * order + train[lang].lower().encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[k][data[i - k:i], data[i]] += 1
        bits, seen = 0.0, b"\n" * order + text.lower().encode()
        for i in range(order, len(seen)):
            for k in range(order, -1, -1):
                follow = {b: n for (c, b), n in counts[k].items() if c == seen[i - k:i]}
                total, kinds = sum(follow.values()), len(follow)
                if seen[i] in follow:
                    bits -= math.log2(follow[seen[i]] / (total + kinds))
                    break
                if total:
                    bits -= math.log2(kinds / (total + kinds))
            else:
                bits += 8
        return bits

    texts = ["Abra", "zzz é", "cab\nabba", "x", ""]
    for text, row in zip(texts, model.bits(texts)):
        assert np.allclose(row, [plain(lang, text) for lang in sorted(train)], rtol=1e-5, atol=1e-3)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog " * 5 if i % 2 else "der hund und die katze " * 5, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "123 !?", "en"), (102, "", None), (103, "the dog", None), (None, "die katze", "de"), (1, rows[1][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid.identify(df, langid.fit(df, ~langid.held_out())).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[100] == by[101] == by[102] == "und" and by[103] == "en" and by[None] == "de"
    assert all(by[i] == ("en" if i % 2 else "de") for i in range(40))
    none = langid.identify(df, langid.fit(df.filter("doc_id < 0"), ~langid.held_out())).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert langid.identify(df.limit(0), langid.fit(df, ~langid.held_out())).count() == 0


# Toxicity

def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.2).astype(int)
    votes = np.zeros((4000, 6 + len(toxicity.PATTERNS)), dtype=bool)
    for j, (hit, false) in enumerate([(0.8, 0.02), (0.7, 0.05), (0.6, 0.01), (0.5, 0.5)]):
        votes[:, j] = rng.random(4000) < np.where(y == 1, hit, false)
    votes[:, 4] = votes[:, 5] = votes[:, 3]  # a clique of copies
    known = np.where(np.arange(4000) < 800, y, -1)
    model = toxicity.label_model(votes, np.ones(4000), known)
    assert abs(model.rates[1, 0] - 0.8) < 0.15 and model.rates[0, 2] < 0.05
    assert model.discount[3] > 2 > model.discount[0]
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.93


def test_toxicity_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        words = [word() for _ in range(20)] + (["zurgle" + rng.choice(["", "n", "t"])] * 2 if bad else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(500, None), (501, ""), (502, "you are an idiot and a moron"), (None, "x"), (1, rows[1][1]), (503, "word " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(0)).withColumn("y", F.lit(0))
    marks = spark.createDataFrame([*labels, (0, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, marks, ~toxicity.held_out()).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    out = [i for i in range(300) if held(i, 5, 0)]
    assert all(by[i] == int(i % 4 == 0) for i in out)  # learnt from labels, not written down
    assert by[500] == by[501] == by[503] == 0
    alone = toxicity.scored(docs, marks.limit(0), ~toxicity.held_out()).collect()
    assert len(alone) == len(rows) and {r["doc_id"]: r["score"] for r in alone}[502] == max(r["score"] for r in alone)
    assert toxicity.scored(docs.limit(0), marks, ~toxicity.held_out()).count() == 0


# Language model

def test_scores_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(200):
        words, at = [], rng.randrange(60)
        for _ in range(rng.randrange(30)):
            at = (at * 7 + 1) % 60 if rng.random() < 0.8 else rng.randrange(60)
            words.append(vocabulary[at])
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "Only hapax Ünseen here"), (303, " T1\tt1\n"), (None, "t1 t2"), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rare", F.lit(1))
    got = lm.scored(df, ~lm.held_out(), head=40, vocabulary=20, sample=100_000).collect()
    assert len(got) == len(rows)
    split = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    teach = [split(t) for i, t in rows if not held(i, 10, 0)]
    c = Counter(w for t in teach for w in t)
    n, v = sum(c.values()) + len(teach), len(c) + 1
    log = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    text = dict(rows)
    for r in got:
        words = split(text[r["doc_id"]])
        assert (r["n_tokens"], r["train_tokens"]) == (len(words) + 1, n)
        assert r["n_known"] == sum(w in c for w in words) + 1
        assert abs(r["base_score"] - sum(log(c[w]) for w in words) - log(len(teach))) < 1e-9
        assert r["score"] < 0
    out = [r for r in got if held(r["doc_id"], 10, 0)]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # context helps
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert lm.scored(df.limit(0), ~lm.held_out()).count() == 0
    none = lm.scored(df, F.lit(False)).collect()
    assert all(r["n_known"] == r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    share = np.array([4.0, 1, 3, 2, 2])
    model = lm.train([np.append(rng.integers(1, 5, 30), 0) for _ in range(40)], {}, share / share.sum(), epochs=2)
    p = np.exp(model.first[None] + model.second[:, None] - model.normaliser[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-4)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    share = rng.random(150) + 0.1
    share /= share.sum()
    model = lm.train([np.append(rng.integers(1, 150, 30), 0) for _ in range(40)], {}, share, epochs=2)
    assert len(model.starts) > 2
    every = np.arange(150)
    for one, two in ((0, 0), (7, 0), (149, 60)):
        logs = model.logs(every, np.full(150, one), np.full(150, two), step=64)
        assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_vocabulary_and_training_grow_with_the_corpus(spark):
    assert lm.vocabulary_size(0) == 1022 and lm.vocabulary_size(10**9) > 9 * lm.vocabulary_size(10**6)
    # Every text is learnt from: pairs that each occur in a single text beat the unigram model.
    rows = [(i, f"left{i} right{i} " * 40) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = lm.scored(df, F.lit(True), sample=4_000).collect()
    gains = [r["score"] - r["base_score"] for r in got]
    assert len(got) == 400 and min(gains) > 0


def test_classes_are_summed_once_for_each_context(monkeypatch):
    rng = np.random.default_rng(5)
    share = rng.random(150) + 0.1
    share /= share.sum()
    model = lm.train([np.append(rng.integers(1, 150, 30), 0) for _ in range(20)], {}, share, epochs=1)
    tokens = rng.integers(0, 150, 3000)
    one, two = rng.integers(0, 3, 3000), rng.integers(0, 3, 3000)
    plain = np.concatenate([model.logs(tokens[i:i + 1], one[i:i + 1], two[i:i + 1]) for i in range(300)])
    summed, log_sum = [], lm._log_sum
    monkeypatch.setattr(lm, "_log_sum", lambda z: summed.append(z.shape) or log_sum(z))
    logs = model.logs(tokens, one, two)
    assert np.allclose(logs[:300], plain, atol=1e-4)
    assert sum(n for n, _ in summed) <= 3000 + 9  # each token within its class, nine contexts over all classes


def test_words_and_windows_of_odd_texts():
    texts = [b" a  B c ", b"", b"a", b"\x0bb\x0c c\xc2\xa0d"]
    found, sizes = lm.split(pa.RecordBatch.from_arrays([pa.array(texts).cast(pa.string())], names=["text"]))
    want = [re.findall(rb"[^\x20\x09-\x0d]+", t.lower()) for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and found.to_pylist() == [w for x in want for w in x]
    ids, one, two = lm.windows(lm.ended(np.arange(2, 2 + len(found)), sizes, lm.END), sizes + 1)
    assert ids.tolist() == [2, 3, 4, 0, 0, 5, 0, 6, 7, 0]
    assert one.tolist() == [0, 2, 3, 4, 0, 0, 5, 0, 6, 7] and two.tolist() == [0, 0, 2, 3, 0, 0, 0, 0, 0, 6]


# Quality

def test_compiled_rules_equal_the_model(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["the", "of", "wordy", "Thing"], 30)) for _ in range(150)] + [
        " ".join(rng.choice(["@@@", "##", "a|b", "!!"], 30)) for _ in range(50)]
    x = np.array([quality.statistics(t.encode()) for t in texts])
    y = np.array([1.0] * 150 + [0.0] * 50)
    model = quality.fit(x, y)
    assert 0 < len(model.rules) < 60 and ((model.score(x) >= 0.5) == y).all()
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(quality.STATS))
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], model.score(x))


def test_rules_make_little_java(spark):
    rng = np.random.default_rng(4)
    rules = tuple(quality.Rule(tuple((int(k), bool(k % 2), float(rng.random())) for k in rng.integers(0, len(quality.STATS), 3))) for _ in range(200))
    model = quality.RuleEnsemble(rules, tuple(rng.normal(size=200).tolist()), 0.1)
    x = rng.random((50, len(quality.STATS)))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(quality.STATS))
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], model.score(x))
    java = spark._jvm.PythonSQLUtils.explainString(df.filter(model.column() >= 0.5)._jdf.queryExecution(), "codegen")
    assert 0 < len(java) < 150_000


def test_quality_edges(spark):
    rows = [(i, ("good plain words of text " * 4) if i % 3 else "$$$ ### !!! ||| " * 5) for i in range(90)]
    rows += [(200, None), (201, ""), (None, "x"), (1, rows[1][1]), (202, "y " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("statistics", F.lit(1)).withColumn("upper", F.lit(2))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = quality.scored(docs, labels, ~quality.held_out()).collect()
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert len(got) == len(rows) and all(by[i] == int(i % 3 > 0) for i in range(90) if held(i, 3, 1))
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(90) if i % 3}
    assert quality.scored(docs, labels.limit(0), ~quality.held_out()).select("score").distinct().collect()[0][0] == 0.5
    assert quality.scored(docs.limit(0), labels, ~quality.held_out()).count() == 0
