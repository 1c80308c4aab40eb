"""Secret scans with an incremental ledger of blobs, by DataFrame functions only.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger is a Parquet table
of the (blob, rule version) pairs scanned so far with what was found in them, clean blobs included.
A run scans only the pairs the ledger lacks, appends them, and joins the findings back to every row
that holds the blob.

Defined results: a null or empty text is the blob of the empty text and has no findings; repeated
rows share a blob and its findings; an empty table gives no rows and leaves the ledger as it was. A pair that two jobs
have written to the ledger counts once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import fresh_dir, materialize


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters.

    ``probe`` is a cheaper pattern found in every text that has a match.
    """

    kind: str
    pattern: str
    group: int
    least: int
    probe: str


# Runs of a class are maximal, so asking for their length inside the pattern gives the same matches
# as dropping short ones afterwards; for an assignment it would not.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12,
         r"(?i:passw|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
)
# A key runs to its END line. Without one it takes in header lines, words of base64 and a last, shorter line of it.
# Possessive loops neither backtrack nor recurse, however long the key is.
_GAP = r"(?:\s|\\[rn])++"
_KEY = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=\s\\:,._]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|"
        rf"(?:{_GAP}[A-Za-z-]{{4,}}:\x20[^\r\n]*+)*+(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}}+(?![A-Za-z0-9+/=._-]))++"
        r"(?:[ \t]*(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/]{1,15}+={0,2}+(?=[ \t]*(?:\r?\n|\\n|$)))?|)")
MORE = (
    Rule("private_key", _KEY, 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, r"eyJ[A-Za-z0-9_-]{8}"),
)
RULES = BASE + MORE

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """Changes whenever a rule does, so that every blob is then scanned anew."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _cut(text: Column, rule: Rule) -> Column:
    """Alternating gaps and matches of a text, each with the tested group; the last match is null."""
    pattern = F.lit(rule.pattern)
    return F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"))


_MEASURES = "array<struct<rank:int,i:int,gap:int,hit:int,value:int>>"


def _measured(text: Column, rank: int, rule: Rule) -> Column:
    """Lengths of the pieces :func:`_cut` gives."""
    return F.transform(_cut(text, rule), lambda z, i: F.struct(
        F.lit(rank).alias("rank"), i.alias("i"), F.char_length(z["gap"]).alias("gap"),
        F.char_length(z["hit"]).alias("hit"), F.char_length(z["value"]).alias("value")))


def _masked(text: Column, rule: Rule) -> Column:
    return F.array_join(F.transform(_cut(text, rule), lambda z: F.concat(z["gap"], F.when(
        F.char_length(z["value"]) >= rule.least, F.lit(f"[{rule.kind}]")).otherwise(F.coalesce(z["hit"], F.lit(""))))), "")


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, text`` (one row per blob) to ``blob, spans``, spans by start and then by rule.

    Offsets count code points, the end is exclusive.
    """
    found = [F.when(F.col("text").rlike(rule.probe), _measured(F.col("text"), n, rule)).otherwise(F.array().cast(_MEASURES))
             for n, rule in enumerate(rules)]
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    least = F.array(*[F.lit(r.least) for r in rules])
    # The outer form keeps blobs without findings; they enter the ledger as clean.
    pieces = blobs.select("blob", F.explode_outer(F.concat(*found)).alias("m")).select("blob", "m.*").filter(
        "rank IS NULL OR hit IS NOT NULL")
    before = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(before).cast("int"))
    span = F.struct((F.col("end") - F.col("hit")).alias("start"), "rank", kinds[F.col("rank")].alias("kind"), "end")
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(
        F.when(F.col("value") >= least[F.col("rank")], span))).cast(SPANS).alias("spans"))


def suspect(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a text has a match of any rule, long enough or not; the others need no scan and no shuffle."""
    return reduce(Column.__or__, (text.rlike(rule.probe) & text.rlike(rule.pattern) for rule in rules))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, empty where nothing has been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan_versions(rows: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``blob`` and ``spans`` to ``doc_id, text`` rows (text dropped), scanning only what ``ledger`` lacks.

    ``ledger`` is a folder all executors share, a new one by default. A blob a third of all rows
    hold is reduced before the shuffle, and its findings go back by a join Spark can split. Of texts no rule matches only
    the blob's name is shuffled.
    """
    spark = rows.sparkSession
    path = ledger or fresh_dir(spark, "ledger")
    version = rule_version(rules)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = rows.select("doc_id", F.sha2(text.cast("binary"), 256).alias("blob"), F.when(suspect(text, rules), text).otherwise(F.lit("")).alias("text"))
    known = read_ledger(spark, path).filter(F.col("rule_version") == version)
    unseen = named.groupBy("blob").agg(F.first("text").alias("text")).join(known, "blob", "left_anti")
    scan(unseen, rules).select("blob", F.lit(version).alias("rule_version"), "spans").write.mode("append").parquet(path)
    found = read_ledger(spark, path).filter((F.col("rule_version") == version) & (F.size("spans") > 0)).groupBy("blob").agg(
        F.first("spans").alias("spans"))
    # Written, as Spark splits the rows of a frequent blob only in a join of two plain shuffles.
    found = materialize(found, "found")
    return named.select("doc_id", "blob").join(found, "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with every finding replaced by its kind in brackets, one rule after the other.

    Keys come first, as what another rule replaces inside one would cut it short. A rule's text is bound once: it is
    named five times, and without that the plan would hold the first one five times five for every further rule.
    """
    for rule in sorted(rules, key=lambda r: r.kind != "private_key"):
        text = let(text, lambda t: F.when(t.rlike(rule.probe), _masked(t, rule)).otherwise(t))  # noqa: B023, called at once
    return text
