import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import pieces


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))


def every(lattice, unit):
    """All segmentations of a unit by recursion, as (cost, ids)."""
    into = lattice.edges(unit)
    def back(j):
        if not j:
            return [(0, ())]
        return [(c + cost, ids + k) for i, cost, k in into[j] for c, ids in back(i)]
    return sorted(back(len(unit)))


@pytest.mark.parametrize("unit", ["▁the", "▁token", "▁▁▁a", "naïve", "\n", "汉x", "aaaaaaa", "▁①b"])
def test_unit_search_equals_enumeration(lattice, unit):
    want = every(lattice, unit)
    found = lattice.nbest(unit, 6)
    assert [c for c, _ in found] == [c for c, _ in want[:6]] and len(set(found)) == len(found) and set(found) <= set(want)
    ids, cost, loss = lattice.solve(unit)
    assert (cost, ids) in want and cost == want[0][0]
    assert loss == (want[1][0] - want[0][0] if len(want) > 1 else -1)


@pytest.mark.parametrize("text", ["x" * 20_001, " " * 20_001, "ab" * 10_000, "=" * 20_001, "QUJD" * 5000, "prose and " * 200 + "-" * 20_001, "é" * 20_001])
def test_long_runs_end_soon(lattice, text):
    import time

    started = time.time()
    units = lattice.units.findall(lattice.model.normalize(text))
    for unit in sorted(set(units), key=len)[-2:]:
        found = lattice.nbest(unit, 4)
        ids, cost, loss = lattice.solve(unit)
        assert len(set(found)) == len(found) and found[0][0] == cost and loss == (found[1][0] - cost if len(found) > 1 else -1)
        assert all(lattice.decode(i).replace(" ", "▁").endswith(unit.strip("▁")) for _, i in found)
    assert time.time() - started < 10


@pytest.mark.parametrize("unit", ["▁aaaaaaaaaa", "xyxyxyxyxy", "▁▁▁▁▁▁▁▁"])
def test_ties_equal_enumeration(lattice, unit):
    assert [c for c, _ in lattice.nbest(unit, 9)] == [c for c, _ in every(lattice, unit)[:9]]


def test_texts(spark, lattice):
    texts = ["the cat sat", "a  b\n\nc\td", "", None, "x", "naïve ①🙂 été", " lead and trail ", "word " * 3000, "a" * 3000, "the cat sat", "\n", "a▁b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    encoded = pieces.encode(df, n=5)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i]["exact"] == (text != "a▁b") and lattice.decode(rows[i]["ids"]) == (text or "").replace("▁", " ")
        assert lattice.model.decode(list(rows[i]["ids"])) == (text or "").replace("▁", " ")
        assert [b["cost"] for b in rows[i]["nbest"]] == sorted(b["cost"] for b in rows[i]["nbest"]) and rows[i]["nbest"][0]["cost"] == rows[i]["cost"]
    assert rows[0] [1:] == rows[9][1:] and rows[2]["n_pieces"] == 0 and len(rows[2]["nbest"]) == 1
    # A short text as a whole lattice gives the same costs as unit by unit.
    whole = [c for c, _ in lattice.nbest(lattice.model.normalize("the cat sat"), 5)]
    assert [b["cost"] for b in rows[0]["nbest"]] == whole
    spread = encoded.select("doc_id", "ids", F.posexplode("nbest").alias("k", "b")).select(
        "doc_id", "k", pieces.segmentation(F.col("ids"), F.col("b.edits")).alias("ids"), "b.n_pieces")
    seen = set()
    for r in spread.collect():
        assert lattice.decode(r["ids"]) == (texts[r["doc_id"]] or "").replace("▁", " ") and len(r["ids"]) == r["n_pieces"]
        assert (r["doc_id"], tuple(r["ids"])) not in seen
        seen.add((r["doc_id"], tuple(r["ids"])))
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()}
    assert back[4] == "x" and back[3] == ""
    assert pieces.encode(df.limit(0)).count() == 0


def test_units_solved_together_equal_units_solved_alone(lattice):
    import random

    rng = random.Random(5)
    units = ["▁the", "汉x", "▁①b", "x", "\n", "a" * pieces.SHORT, "a" * (pieces.SHORT + 1), "\U0001f600", "\u0000é", "naïve▁", "①"]
    units += ["".join(rng.choice("▁abcehinorst.,üß①汉\U0001f600%0") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    assert lattice.packed_all(units) == [lattice.packed(u) for u in units]
    assert lattice.packed_all([]) == [] and lattice.packed_all(["b" * 99]) == [lattice.packed("b" * 99)]


def test_units_not_held_are_solved_by_one_call():
    from shelfmark.llm.common import Frequent

    calls = []
    held = Frequent(None, 8, lambda keys: calls.append(sorted(keys)) or [ord(k) for k in keys])
    assert held.values_of({"a", "b"}) == {"a": 97, "b": 98}
    assert held.values_of({"b", "c"}) == {"b": 98, "c": 99}
    assert held.values_of({"b", "c"}) == {"b": 98, "c": 99} and calls == [["a", "b"], ["b", "c"], ["c"]]
    for a in range(0, 26, 2):
        for _ in range(3):
            assert held.values_of(set(map(chr, (a, a + 1)))) == {chr(a): a, chr(a + 1): a + 1}
            assert len(held) <= 4


def test_units_are_cut_as_the_pattern_cuts_them(lattice):
    assert lattice.plain
    rng = random.Random(4)
    for text in ["", "▁", "\n", "▁a\n▁b", "\n\n▁\n", "a▁▁b", "a\0b▁c", *("".join(rng.choices("▁\nab\0é", (6, 2, 4, 4, 0.2, 2), k=rng.randrange(20))) for _ in range(500))]:
        assert lattice.units_of(text) == lattice.units.findall(text)
