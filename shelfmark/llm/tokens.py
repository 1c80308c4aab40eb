"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where they agree.

The tokenizer cuts a text into pre-tokens from left to right, looking no further back than the piece
it is in, and encodes each by itself. So once two scans of a text stand at the same boundary, they give the
same pieces from there on. A long text is cut into chunks that overlap; each is scanned from its own
start, and two neighbours are spliced at the first boundary both have, the last two pieces of the left one
left out because the cut may have changed them. Where no boundary agrees, the overlap is doubled, up
to the whole text, so the count always equals the library's.

Defined results: a null or empty text has no bytes and no tokens; special strings inside a text count
as the one token the library makes of them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

CHUNK = 1 << 16  # characters encoded at once
OVERLAP = 1 << 10
LIMIT = 512
CACHE = 1 << 19

# Characters whose class all Unicode versions agree on; other texts are cut by the library itself.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ɏ]*")
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_PIECE = re.compile(rf"'(?:[smtd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")


def spliced(text: str, cut: Callable[[str], list[str]], chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """The pre-tokens of a text in order, list by list, found by overlapping chunks.

    A piece that no boundary divides is as long as it is; apart from that, memory is a chunk's.
    """
    n = len(text)
    start = 0  # a proven boundary; nothing before it is left to count
    edge = min(n, chunk)
    wide = overlap
    stop = min(n, edge + wide)
    left = cut(text[start:stop])
    while stop < n:
        begin = max(start, edge - wide)
        end = min(n, edge + chunk + overlap)
        right = cut(text[begin:end])
        ends, at = {begin: 0}, begin
        for i, piece in enumerate(right, 1):
            at += len(piece)
            if at > stop:
                break
            ends[at] = i
        at, meet = start, None
        for i, piece in enumerate(left[:-2] if stop < n else left):
            if at in ends:
                meet = i, ends[at]
                break
            at += len(piece)
        if meet is None:
            wide *= 2
            stop = min(n, edge + wide)
            left = cut(text[start:stop])
            continue
        yield left[:meet[0]]
        start, left = at, right[meet[1]:]
        edge, stop, wide = min(n, edge + chunk), end, overlap
    yield left


class Counter:
    """Token counts by the ``tokenizers`` library, each distinct pre-token encoded once."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's cores are Spark's to share out
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        special = sorted((t.content for t in self.model.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.chunk, self.overlap, self.known = chunk, overlap, {}

    def cut(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PIECE.findall(text)
        return [text[a:b] for _, (a, b) in self.model.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, pieces: set[str]) -> None:
        missing = [p for p in pieces if p not in self.known]
        if len(self.known) + len(missing) > CACHE:
            self.known, missing = {}, list(pieces)
        for piece, found in zip(missing, self.model.encode_batch(missing, add_special_tokens=False)):
            self.known[piece] = len(found)

    def counts(self, batch: list[str]) -> list[int]:
        waiting: list[tuple[int, list[str]]] = []
        total, held = [0] * len(batch), 0

        def settle() -> None:
            self.learn(set().union(*(p for _, p in waiting)))
            for i, pieces in waiting:
                total[i] += sum(map(self.known.__getitem__, pieces))
            waiting.clear()

        for i, text in enumerate(batch):
            parts = self.special.split(text) if self.special else [text]
            total[i] += len(parts) - 1
            for part in parts:
                for pieces in spliced(part, self.cut, self.chunk, self.overlap):
                    waiting.append((i, pieces))
                    held += len(pieces)
                    if held > CACHE // 2:
                        settle()
                        held = 0
        settle()
        return total


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; one narrow pass.

    ``path`` names a ``tokenizers`` file every executor has; by default the public byte-level BPE.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = Counter(path or public_tokenizers.path("byte_bpe_50k.json"), chunk, overlap)
        for batch in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counter.counts(batch.column("text").to_pylist()), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
