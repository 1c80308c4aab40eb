"""Text splitters as Column functions: one text in, an array of drafts out.

A draft is ``struct<content, start, end, token_count>``; fields a strategy has no use
for are null. All work happens inside the row that holds the text, so chunking a
corpus needs no shuffle and no row ever waits for another document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DRAFT_TYPE, Variant
from .text import SENTENCE_END, jtrim, let, space_tokens
from .vectors import nearest_rank

# The separators tried from coarse to fine before cutting by character.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ")
IDENTICAL_SPREAD = 1e-6

_NO_DRAFTS = f"cast(array() as array<{DRAFT_TYPE}>)"
_NO_TEXTS = "cast(array() as array<string>)"


def _draft(content: Column, start: Column | None = None, end: Column | None = None,
           tokens: Column | None = None) -> Column:
    null = F.lit(None).cast("int")
    return F.struct(
        content.alias("content"),
        (null if start is None else start.cast("int")).alias("start"),
        (null if end is None else end.cast("int")).alias("end"),
        (null if tokens is None else tokens.cast("int")).alias("token_count"),
    )


def _plain(texts: Column) -> Column:
    return F.transform(texts, lambda t: _draft(t))


def densify(drafts: Column) -> Column:
    """Trim every draft and drop the empty ones; array position is the chunk index."""
    trimmed = F.transform(drafts, lambda d: d.withField("content", jtrim(d["content"])))
    return F.filter(trimmed, lambda d: d["content"] != "")


def overlap_prefix(texts: Column, overlap: int) -> Column:
    """Give every text but the first the tail of its predecessor and a space.

    The tail comes from the predecessor as it was before it got its own prefix.
    """
    if overlap <= 0:
        return texts
    return let(
        texts,
        lambda all_: F.transform(
            all_,
            lambda t, i: F.when(i == 0, t).otherwise(
                F.concat(F.right(F.element_at(all_, F.greatest(i, F.lit(1))), F.lit(overlap)), F.lit(" "), t)
            ),
        ),
    )


def char_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters every ``size - overlap``, while the start is inside.

    The text is cut once into steps; a window is the join of the steps it covers.
    Taking substrings by position instead would rescan the text for every window.
    """
    step = size - overlap
    reach = -(-size // step)
    steps = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0))
    return let(
        steps,
        lambda s: F.transform(
            s,
            lambda _, i: F.substring(F.array_join(F.slice(s, i + 1, F.lit(reach)), ""), 1, size),
        ),
    )


def split_fixed(text: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    return F.transform(
        char_windows(text, size, overlap),
        lambda w, i: _draft(w, i * step, i * step + F.length(w)),
    )


def split_token(text: Column, max_tokens: int, overlap: int) -> Column:
    """Windows of ``max_tokens`` white-space tokens joined by one space."""
    step = max_tokens - overlap
    starts = lambda n: F.filter(  # noqa: E731 - the empty text has no window
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: s < n
    )
    return let(
        space_tokens(text),
        lambda t: F.transform(
            starts(F.size(t)),
            lambda s: let(
                F.slice(t, s + 1, F.lit(max_tokens)),
                lambda w: _draft(F.array_join(w, " "), tokens=F.size(w)),
            ),
        ),
    )


def _pack(parts: Column, separator: str, size: int) -> Column:
    """Greedily join neighbours up to ``size``; a longer part is passed through alone."""
    gap = len(separator)
    zero = F.expr(f"named_struct('out', {_NO_TEXTS}, 'cur', '')")

    def merge(acc: Column, part: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        empty, long_part = cur == "", F.length(part) > size
        joined = F.when(empty, part).otherwise(F.concat(cur, F.lit(separator), part))
        fits = F.length(cur) + F.length(part) + F.when(empty, 0).otherwise(gap) <= size
        flushed = F.when(empty, out).otherwise(F.array_append(out, cur))
        return (
            F.when(fits, F.struct(out.alias("out"), joined.alias("cur")))
            .when(long_part, F.struct(F.array_append(flushed, part).alias("out"), F.lit("").alias("cur")))
            .otherwise(F.struct(flushed.alias("out"), part.alias("cur")))
        )

    return F.aggregate(
        parts, zero, merge,
        lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])),
    )


def split_recursive(text: Column, size: int, overlap: int) -> Column:
    """Split at the coarsest separator that keeps pieces within ``size``.

    One array pass per separator: pieces that fit stay, longer ones are split and packed.
    """
    def refine(pieces: Column, separator: str) -> Column:
        return F.flatten(F.transform(
            pieces,
            lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(
                _pack(F.split(p, "\\Q%s\\E" % separator), separator, size)
            ),
        ))

    pieces = reduce(refine, SEPARATORS, F.array(text))
    pieces = F.flatten(F.transform(
        pieces,
        lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(char_windows(p, size, overlap)),
    ))
    kept = F.filter(F.transform(pieces, jtrim), lambda t: t != "")
    return _plain(overlap_prefix(kept, overlap))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), jtrim), lambda s: s != "")


def break_flags(distances: Column, percentile: float) -> Column:
    """Per distance, whether a chunk starts after it; none when all distances agree."""
    return let(
        distances,
        lambda d: F.when(
            F.size(d) == 0, F.expr("cast(array() as array<boolean>)")
        ).otherwise(let(
            F.struct(
                nearest_rank(F.array_sort(d), percentile).alias("cut"),
                (F.array_max(d) - F.array_min(d) > F.lit(IDENTICAL_SPREAD).cast("float")).alias("varied"),
            ),
            lambda t: F.transform(d, lambda x: t["varied"] & (x >= t["cut"])),
        )),
    )


def pack_sentences(items: Column, size: int) -> Column:
    """Join ``struct<s, brk>`` items by a space up to ``size``, starting anew at breaks.

    A sentence longer than ``size`` is cut into pieces of exactly ``size``.
    """
    zero = F.expr(f"named_struct('out', {_NO_TEXTS}, 'cur', '')")

    def merge(acc: Column, item: Column) -> Column:
        s, cur, out = item["s"], acc["cur"], acc["out"]
        empty = cur == ""
        flushed = F.when(empty, out).otherwise(F.array_append(out, cur))
        full = ~empty & (item["brk"] | (F.length(cur) + 1 + F.length(s) > size))
        return (
            F.when(
                F.length(s) > size,
                F.struct(F.concat(flushed, char_windows(s, size, 0)).alias("out"), F.lit("").alias("cur")),
            )
            .when(full, F.struct(flushed.alias("out"), s.alias("cur")))
            .otherwise(F.struct(
                out.alias("out"),
                F.when(empty, s).otherwise(F.concat(cur, F.lit(" "), s)).alias("cur"),
            ))
        )

    return F.aggregate(
        items, zero, merge,
        lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])),
    )


def pack_by_breaks(sents: Column, flags: Column, size: int) -> Column:
    items = let(
        flags,
        lambda f: F.transform(
            sents,
            lambda s, i: F.struct(
                s.alias("s"),
                F.when(i == 0, F.lit(False)).otherwise(
                    F.coalesce(F.get(f, i - 1), F.lit(False))
                ).alias("brk"),
            ),
        ),
    )
    return pack_sentences(items, size)


def group_semantic(text: Column, sents: Column, distances: Column, size: int, overlap: int,
                   percentile: float) -> Column:
    """Drafts of sentences grouped until the topic shifts or the window is full."""
    grouped = pack_by_breaks(sents, break_flags(distances, percentile), size)
    return densify(_plain(
        F.when(F.length(text) <= size, F.array(text)).otherwise(overlap_prefix(grouped, overlap))
    ))


def split(text: Column, variant: Variant) -> Column:
    """Drafts of ``text`` under ``variant``, trimmed and without empty ones.

    The semantic strategy needs a model between two steps, so it has no such form;
    see :func:`shelfmark.operators.chunking.with_drafts`.
    """
    if variant.strategy == "fixed":
        drafts = split_fixed(text, variant.size, variant.overlap)
    elif variant.strategy == "token":
        drafts = split_token(text, variant.max_tokens, variant.token_overlap)
    elif variant.strategy == "recursive":
        drafts = split_recursive(text, variant.size, variant.overlap)
    else:
        raise ValueError(f"no single expression for strategy {variant.strategy!r}")
    return densify(drafts)
