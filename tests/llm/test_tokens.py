import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def samples():
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "12", "!?", "…", "汉字", "🙂", " ", "\x1c", "<|endoftext|>", "<|endof", "²"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    return out + ["", " ", "a" * 3000, " " * 3000, "ab " * 2000, "é" * 500 + " x", "<|endoftext|>" * 40, "\r\n" * 300, "don't we'll I'm 'S"]


def test_counts_equal_the_library(library):
    texts = samples()
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    for chunk, overlap in ((1 << 16, 1 << 10), (64, 8), (17, 2)):
        assert tokens.Counter(PATH, chunk, overlap).counts(texts) == want


def test_splices_are_the_pieces():
    counter = tokens.Counter(PATH)
    for text in samples():
        if "<|" not in text:
            joined = [p for part in tokens.spliced(text, counter.cut, 40, 4) for p in part]
            assert joined == counter.cut(text)


def test_table(spark, library):
    texts = samples() + [None, samples()[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    rows = {r["doc_id"]: r for r in tokens.count_tokens(df).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False))
        assert (rows[i]["n_tokens"], rows[i]["n_bytes"], rows[i]["over_limit"]) == (n, len((text or "").encode()), n > 512)
    assert tokens.count_tokens(df.limit(0)).count() == 0
