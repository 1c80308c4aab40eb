import random
import re
import time

from pyspark.sql import functions as F

from shelfmark.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def table_sum(number):
    return sum(int("0246813579"[int(c)]) if i % 2 else int(c) for i, c in enumerate(number[::-1]))


def passes(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(number) <= 19 and table_sum(number) % 10 == 0
    return 9 <= len(number) <= 15 if kind == "phone" else True


def brute(text):
    """The contract's base spans, straight from its patterns."""
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, p) in enumerate(PATTERNS.items())
             for m in p.finditer(text or "") if passes(kind, m.group())]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


TEXTS = [
    "write to a.b+c@mail.example.org, or x@y, or x@y.z@w.v and @no.local",
    "a@b.c.+d@e.f a@b..c é@x.yz 🙂q%_@A-B.C--.d.", "10.0.0.1.2.3.4 256.1.1.1 1.2.3 0001.002.03.4 1.2.3.4.5.6.7.8 9999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 411111111111 1111  4111 1111 1111 1111 0",
    "+49 (0)30 123456-78. +1.555.0100 +12 +1 (((( +123456789012345 +1234567890123456 + 49 30 1234567 +4930 1234567+1 555 123 4567",
    "", None, "plain words", "5500005555555559@x.yz 10.0.0.1@h.st +4111111111111111", "4" * 12 + "-" + "1" * 5,
]


def base(spans):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["rank"] < len(pii.BASE)]


def table(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.select("doc_id", "text", F.lit(1).alias("spans"), F.lit("x").alias("row_key"), F.lit(0).alias("kind"))


def test_base_spans_equal_the_patterns(spark):
    rows = pii.find(table(spark, TEXTS * 2)).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert base(r["spans"]) == brute(TEXTS[r["doc_id"] % len(TEXTS)])
    assert {s["kind"] for r in rows for s in r["spans"]} >= {"email", "ip", "card", "phone"}


def test_random_texts_equal_the_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choices(["a", "@", ".", "1", "25", "4111 1111", " ", "-", "+", "(", ")", "é", "_", "x.y", "+49", "0"], k=rng.randrange(1, 40)))
        assert [f"{k}:{a}:{b}" for a, rank, k, b, _ in pii.spans(text) if rank < 4] == brute(text), text


def test_validators():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and pii.mod97("GB82WEST12345698765432") and not pii.mod97("DE88 3704 0044 0532 0130 00")
    assert pii.small_parts("0255.0.00.1") and not pii.small_parts("1.2.3.256") and not pii.small_parts("9" * 5000 + ".1.1.1")
    assert not pii.social_number("666-12-3456") and not pii.social_number("900-12-3456") and pii.social_number("123-45-6789")


def test_context_and_kinds_beyond_the_base():
    kinds = lambda text: [s[2] for s in pii.spans(text)]
    assert kinds("pay to DE89370400440532013000 now") == ["iban"]
    assert kinds("pay to DE88370400440532013000 now") == []
    assert kinds("His social security number is 123-45-6789.") == ["ssn"]
    assert kinds("The part 123-45-6789 is sold out.") == []
    assert kinds("SSN or serial 123-45-6789") == []
    score = lambda text: pii.spans(text)[0][4]
    assert score("version 10.20.30.40") < score("at 10.20.30.40") < score("server 10.20.30.40")
    assert score("far " + "x" * 60 + " 10.20.30.40 server") == score("server 10.20.30.40")


def test_very_long_runs_take_linear_time():
    started = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" + " " * 300_000, "1." * 150_000, "a." * 100_000 + "@", "1-" * 150_000, "1.1.1." * 50_000 + "x"):
        pii.spans(text)
    assert time.time() - started < 20


def test_masking_and_empty_table(spark):
    df = table(spark, ["mail a@b.cd now", None, "", "5500005555555559@x.yz", "🙂 +1 555 123 4567 é"]).orderBy("doc_id")
    assert [r[0] for r in df.select(pii.masked(F.col("text"))).collect()] == ["mail [email] now", None, "", "[email]", "🙂 [phone] é"]
    assert pii.find(df.limit(0)).count() == 0
