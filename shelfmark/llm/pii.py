"""Personal data by proposed spans, validators and context.

Regular expressions propose spans, the leftmost non-overlapping ones of each kind. A validator drops what cannot be of
its kind and confirms what carries a check of its own: the Luhn sum of card numbers, the remainder by 97 of account
numbers, the ranges of address parts and of social security numbers. Words nearby move the score of a span: words
that go with its kind raise it, words that go with numbers of another sort lower it.

The four base kinds are reported whatever their score. The kinds beyond them are reported from ``least`` on, so a
number that only looks like theirs needs a check or a word to be taken.

Offsets count code points, the end is exclusive. Every scan is linear in the text: a proposal that fails is not
tried again from within its own run of characters. One narrow pass over whole texts.

Defined results: a null or empty text has no spans; repeated rows have equal spans; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

BEFORE, AFTER = 48, 24   # characters around a span that are searched for context words
RAISED, LOWERED = 0.4, 0.2
LEAST = 0.6

Found = Iterator[tuple[int, int]]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_FOUR = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
# Runs of digits are maximal, so asking for twelve of them here only drops what is dropped anyway.
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", re.ASCII)
_SOCIAL = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII)


def emails(text: str) -> Found:
    """What lies around each ``@``: the run before it, up to the last match, and a domain of two labels or more."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def addresses(text: str) -> Found:
    if _DOTTED.search(text):
        for m in _FOUR.finditer(text):
            yield m.span()


def _matches(pattern: re.Pattern) -> Callable[[str], Found]:
    def run(text: str) -> Found:
        for m in pattern.finditer(text):
            yield m.span()

    return run


def digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Whether the digits, every second one from the right doubled, sum to a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether the account number, its head moved to the end and letters as two digits, leaves 1 when divided by 97."""
    compact = account.replace(" ", "")
    left = 0
    for c in compact[4:] + compact[:4]:
        value = int(c, 36)
        left = (left * (100 if value > 9 else 10) + value) % 97
    return left == 1


def small_parts(address: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in address.split("."))


def card_number(value: str) -> bool:
    number = digits(value)
    return 12 <= len(number) <= 19 and luhn(number)


def account_number(value: str) -> bool:
    return 15 <= len(value.replace(" ", "")) <= 34 and mod97(value)


def social_number(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Kind:
    """``score`` is what a valid proposal has without context."""

    name: str
    propose: Callable[[str], Found]
    valid: Callable[[str], bool]
    score: float
    near: str


BASE = (
    Kind("email", emails, lambda value: True, 0.9, "mail|contact|write to"),
    Kind("ip", addresses, small_parts, 0.5, "address|server|host|login|client"),
    Kind("card", _matches(_DIGITS), card_number, 0.8, "card|visa|credit|debit|payment"),
    Kind("phone", _matches(_PLUS), lambda value: 9 <= len(digits(value)) <= 15, 0.6, "phone|call|tel|mobile|fax"),
)
MORE = (
    Kind("iban", _matches(_ACCOUNT), account_number, 0.9, "iban|account|bank|transfer"),
    Kind("ssn", _matches(_SOCIAL), social_number, 0.3, "ssn|social security|taxpayer"),
)
KINDS = BASE + MORE
OTHER_NUMBERS = "version|isbn|invoice|order no|serial|tracking"

_NEAR = {k.name: re.compile(k.near, re.IGNORECASE | re.ASCII) for k in KINDS}
_FAR = re.compile(OTHER_NUMBERS, re.IGNORECASE | re.ASCII)


def spans(text: str, kinds: tuple[Kind, ...] = KINDS, least: float = LEAST) -> list[tuple[int, int, str, int, float]]:
    """``start, rank, kind, end, score`` of all spans, by start and then by kind."""
    found = []
    for rank, kind in enumerate(kinds):
        for start, end in kind.propose(text):
            if kind.valid(text[start:end]):
                around = f"{text[max(0, start - BEFORE):start]}\n{text[end:end + AFTER]}"
                near = _NEAR.get(kind.name) or re.compile(kind.near, re.IGNORECASE | re.ASCII)
                score = kind.score + RAISED * bool(near.search(around)) - LOWERED * bool(_FAR.search(around))
                score = round(min(1.0, max(0.0, score)), 2)
                if kind in BASE or score >= least:
                    found.append((start, rank, kind.name, end, score))
    return sorted(found)


SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"
_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("score", pa.float64())]))
_NAMES = ("start", "rank", "kind", "end", "score")


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = LEAST) -> DataFrame:
    """``doc_id, row_key, spans`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [[dict(zip(_NAMES, s)) for s in spans(t, kinds, least)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(found, _TYPE)], names=["doc_id", "row_key", "spans"])

    return texts(docs).mapInArrow(run, f"doc_id long, row_key long, spans {SPANS}")


def hidden(text: str | None) -> str | None:
    """The text with every span, or run of spans that overlap, replaced by the first one's kind in brackets."""
    if not text:
        return text
    out, end = [], 0
    for start, _, kind, stop, _ in spans(text):
        if start >= end:
            out += [text[end:start], f"[{kind}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def masked(text: Column) -> Column:
    """A text column without its personal data."""
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([hidden(t) for t in values.to_pylist()], pa.string())

    return run(text)
