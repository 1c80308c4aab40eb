"""Splitters against the worked examples and against plain-Python descriptions."""

import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import splitters as S
from shelfmark.functions.embedders import ModelEmbedder, hashing_model, row_distances
from shelfmark.functions.text import jtrim
from shelfmark.functions.vectors import hashing_embedding
from shelfmark.model import Variant
from shelfmark.operators import chunking

def T():
    return F.col("t")
SPACE = "".join(map(chr, range(33)))
SEPS = ["\n\n", "\n", ". ", "? ", "! ", " "]


def texts_of(drafts):
    return F.transform(drafts, lambda d: d["content"])


def fixed_model(text, size, overlap):
    return [w for s in range(0, len(text), size - overlap) if (w := text[s:s + size].strip(SPACE))]


def pieces_model(text, size, overlap, level=0):
    """All pieces of a text from separator ``level`` on."""
    if len(text) <= size:
        return [text]
    if level == len(SEPS):
        return [text[i:i + size] for i in range(0, len(text), size - overlap)]
    groups, run = [], None
    for part in text.split(SEPS[level]):
        if len(part) > size:
            groups.append(run)
            groups.append(pieces_model(part, size, overlap, level + 1))
            run = None
        elif run and len(run) + len(SEPS[level]) + len(part) <= size:
            run = run + SEPS[level] + part
        elif run:
            groups.append(run)
            run = part
        else:
            run = part
    groups.append(run)
    return [p for g in groups if g for p in (g if isinstance(g, list) else [g])]


def prefixed(texts, overlap):
    return [t if i == 0 or not overlap else texts[i - 1][-overlap:] + " " + t for i, t in enumerate(texts)]


def recursive_model(text, size, overlap):
    kept = [p for piece in pieces_model(text, size, overlap) if (p := piece.strip(SPACE))]
    return [p for t in prefixed(kept, overlap) if (p := t.strip(SPACE))]


def semantic_model(text, size, overlap, vectors, percentile=95):
    if len(text) <= size:
        return [text.strip(SPACE)]
    sents = [s for x in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n[ \t\n\x0b\f\r]*\n", text) if (s := x.strip(SPACE))]
    cuts = set()
    if len(sents) > 1:
        d = row_distances(vectors(sents))
        if d.max() - d.min() > np.float32(1e-6):
            cut = np.sort(d)[max(0, int(np.ceil(percentile / 100 * len(d))) - 1)]
            cuts = {i + 1 for i in range(len(d)) if d[i] >= cut}
    out = []
    joinable = False
    for i, s in enumerate(sents):
        if len(s) > size:
            out += [s[j:j + size] for j in range(0, len(s), size)]
            joinable = False
        elif joinable and i not in cuts and len(out[-1]) + 1 + len(s) <= size:
            out[-1] += " " + s
        else:
            out.append(s)
            joinable = True
    return [p for t in prefixed(out, overlap) if (p := t.strip(SPACE))]


WORDS = st.lists(
    st.sampled_from(["a", "bb", "Kafka", "streams.", "why?", "yes!", "\n", "\n\n", " ", "é" * 7, "x" * 45, ". "]),
    max_size=60,
).map(lambda ws: " ".join(ws))


@given(st.lists(WORDS, min_size=5, max_size=20))
@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
def test_splitters_match_models(value, texts):
    got = value(
        texts, texts_of(S.densify(S.split_fixed(T(), 20, 7))), texts_of(S.densify(S.split_token(T(), 5, 1))),
        texts_of(S.densify(S.split_recursive(T(), 40, 8))), texts_of(S.densify(S.split_recursive(T(), 30, 0))))
    for text, (fixed, token, rec8, rec0) in zip(texts, got):
        assert fixed == fixed_model(text, 20, 7)
        words = text.split()
        assert token == [" ".join(words[i:i + 5]) for i in range(0, len(words), 4)]
        assert rec8 == recursive_model(text, 40, 8)
        assert rec0 == recursive_model(text, 30, 0)
        assert all(len(p) <= 30 for p in rec0)


@given(st.lists(WORDS, min_size=5, max_size=20))
@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
def test_semantic_matches_model(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = chunking.chunk_semantic(docs, 40, 8).orderBy("doc_id", "chunk_index").collect()
    model = hashing_model(64)
    for i, text in enumerate(texts):
        want = semantic_model(text, 40, 8, model) if text.strip() else []
        assert [r["content"] for r in rows if r["doc_id"] == i] == want


def test_examples(value):
    a100, xs = "A" * 100, "X" * 100
    got = value([a100, "Short text", "   "], texts_of(S.densify(S.split_recursive(T(), 40, 8))),
                texts_of(S.densify(S.split_token(T(), 5, 1))))
    assert got[0][0][0] == "A" * 40 and len(got[0][0]) == 4
    assert got[1] == (["Short text"], ["Short text"])
    assert got[2] == ([], [])
    assert value([xs], texts_of(S.group_semantic(
        T(), S.sentences(T()), F.expr("cast(array() as array<float>)"), 40, 0, 95.0)))[0] == ["X" * 40, "X" * 40, "X" * 20]


def test_topics_split_in_two(spark):
    """Two topics, told apart by a model that knows the sentences."""
    def factory():
        return lambda texts: np.asarray([[1, 0] if "cat" in t else [0, 1] for t in texts], dtype=np.float32)

    docs = spark.createDataFrame([(1, "A cat sat. The cat ran. A car drove. The car stopped.")], "doc_id long, text string")
    rows = chunking.chunk_semantic(docs, 45, 0, embedder=ModelEmbedder(factory, 2)).orderBy("chunk_index").collect()
    assert [r["content"] for r in rows] == ["A cat sat. The cat ran.", "A car drove. The car stopped."]


def test_document_that_fits_is_never_embedded(spark):
    def factory():
        def refuse(texts):
            raise AssertionError("no text should reach the model")
        return refuse

    docs = spark.createDataFrame([(1, "One. Two.")], "doc_id long, text string")
    assert [r["content"] for r in chunking.chunk_semantic(docs, 40, 0, embedder=ModelEmbedder(factory)).collect()] == ["One. Two."]


def test_chunk_metadata_and_ids(spark):
    docs = spark.createDataFrame([(1, "word " * 30, {"source": "s", "start": "x"})], "doc_id long, text string, m map<string,string>")
    rows = chunking.chunk(docs, Variant("v", "fixed", 40, 10), metadata="m").orderBy("chunk_index").collect()
    assert rows[1]["metadata"] == {"source": "s", "strategy": "fixed", "start": "30", "end": "70"}
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    again = chunking.chunk(docs, Variant("v", "fixed", 40, 10)).select("chunk_id").collect()
    assert {r["chunk_id"] for r in again} == {r["chunk_id"] for r in rows}


@pytest.mark.parametrize("args", [("bad id", "fixed", 10, 0), ("v", "magic", 10, 0), ("v", "fixed", 0, 0),
                                  ("v", "fixed", 10, 10), ("v", "token", 3, 2), ("", "fixed", 10, 0)])
def test_variant_rejects(args):
    with pytest.raises(ValueError):
        Variant(*args)


def test_hashing_embedding_native_equals_model(value):
    texts = ["Hello, hello World_1!", "", "été ß 12 a_b", "x " * 50]
    got = value(texts, hashing_embedding(T(), 16))
    assert np.array_equal(np.asarray(got), hashing_model(16)(texts))


def test_jtrim_takes_control_characters(value):
    assert value(["\x01\t a b \x1f\n", " x"], jtrim(T())) == ["a b", " x"]


def test_compare_chunking_counts(spark):
    docs = spark.createDataFrame([(i, "One two three. Four five six! " * (i * 10)) for i in range(4)], "doc_id long, text string")
    variants = [Variant("r", "recursive", 100, 10), Variant("s", "semantic", 100, 10), Variant("f", "fixed", 100, 10)]
    rows = {r["variant"]: r for r in chunking.compare_chunking(docs, variants, baseline="r").collect()}
    assert rows["r"]["documents"] == 3 and rows["r"]["ratio_to_baseline"] == 1.0
    assert rows["s"]["split_embeds"] == 2 * 10 * (1 + 2 + 3)
    assert rows["f"]["chunks"] == chunking.chunk_fixed(docs, 100, 10).count()


def test_pack_rows(spark):
    """Pieces of long and short documents equal a plain loop, over many Arrow batches."""
    import random

    from shelfmark.operators.packing import pack_rows

    rnd = random.Random(3)
    docs = {"long": ["x" * rnd.randrange(0, 90) for _ in range(25_000)], "one": ["a" * 500], "empty": [""], "nulls": [None, "b", None], None: ["n"] * 60}
    rows = [(d, i, p) for d, ps in docs.items() for i, p in enumerate(ps)]
    rnd.shuffle(rows)
    found = pack_rows(spark.createDataFrame(rows, "d string, i int, part string"), "d", "i", "part", 100, "--")
    got = {}
    for r in found.collect():
        got.setdefault(r["d"], {})[r["piece_index"]] = r["content"]
    for d, ps in docs.items():
        want, held = [], None
        for p in ps:
            p = p or ""
            if held is not None and len(held) + 2 + len(p) > 100:
                want.append(held)
                held = None
            held = p if held is None else f"{held}--{p}"
        assert [got[d][k] for k in sorted(got[d])] == [*want, held] and sorted(got[d]) == list(range(len(want) + 1))
    assert "BatchEval" not in found._jdf.queryExecution().executedPlan().toString()


def test_simple_upper_keeps_the_length(value):
    from shelfmark.functions.text import simple_upper

    assert value(["Stra\u00dfe \u0149 \u1f80 \ufb01 \u00e9", "", None], simple_upper(F.col("t"))) == ["STRA\u1e9eE \u0149 \u1f88 \ufb01 \u00c9", "", None]


def test_hashing_model_keeps_a_bounded_number_of_tokens():
    import tracemalloc

    model = hashing_model(8)
    tracemalloc.start()
    for at in range(0, 300_000, 1000):
        model([" ".join(f"word{i}" for i in range(at, at + 1000))])
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 16 << 20
    assert (model(["word1 word299999"]) == hashing_model(8)(["word1 word299999"])).all()
