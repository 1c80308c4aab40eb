"""String expressions. Everything here is a plain Column, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_SPACE = r"[ \t\n\x0B\f\r]+"
WORD_TOKEN = r"[\p{L}\p{N}']+"
SENTENCE_END = r"(?<=[.!?])[ \t\n\x0B\f\r]+|\n[ \t\n\x0B\f\r]*\n"
_CONTROL_AND_SPACE = "".join(chr(c) for c in range(0x21))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A column captured by a lambda is evaluated again for every element, which turns
    a linear pass over an array into a quadratic one; binding it avoids that.
    """
    return F.transform(F.array(value), body).getItem(0)


def unnest(df: DataFrame, keep: Sequence[str | Column], array: Column | str, pos: str, item: str) -> DataFrame:
    """One row per array element, as ``pos`` and ``item``.

    The outer form is used on purpose: for the plain one the optimizer adds a test that
    the array is not empty below the generator, and an array that is computed by a fold
    or a UDF would then be computed several times.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())


def jtrim(c: Column) -> Column:
    """Strip every leading and trailing character up to U+0020."""
    return F.btrim(c, F.lit(_CONTROL_AND_SPACE))


# Letters whose upper case is longer than one character, with the single one that stands for them where there is one.
_LONG_UPPER = {c: "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c
               for c in map(chr, range(0x10000)) if len(c.upper()) > 1}
_HELD = "".join(chr(0xF0000 + i) for i in range(len(_LONG_UPPER)))


def simple_upper(c: Column) -> Column:
    """Upper case letter by letter, so that the length stays: sharp s becomes its capital and not a double s."""
    held = F.translate(c, "".join(_LONG_UPPER), _HELD)
    return F.translate(F.upper(held), _HELD, "".join(_LONG_UPPER.values()))


def is_blank(c: Column) -> Column:
    """True for null, empty or white space only."""
    return ~F.coalesce(c, F.lit("")).rlike(r"\P{javaWhitespace}")


def norm_content(c: Column) -> Column:
    """The form under which two chunk texts count as the same."""
    return F.lower(F.regexp_replace(jtrim(F.coalesce(c, F.lit(""))), ASCII_SPACE, " "))


def word_tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD_TOKEN), F.lit(0))


def space_tokens(c: Column) -> Column:
    """Runs of non-space characters, each stripped of control characters."""
    return F.transform(
        F.filter(F.split(c, ASCII_SPACE), lambda t: t != ""), lambda t: jtrim(t)
    )


def preview(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def abbreviate(c: Column, n: int = 160, empty: str = "(no results)") -> Column:
    """The first ``n`` characters and an ellipsis when something was cut."""
    return (
        F.when(is_blank(c), F.lit(empty))
        .when(F.length(c) <= n, c)
        .otherwise(F.concat(F.left(c, F.lit(n)), F.lit("...")))
    )


def content_hash(c: Column) -> Column:
    """SHA-256 hex of a string's UTF-8 bytes or of a binary value."""
    return F.sha2(c, 256)


def stable_id(*parts: Column | str) -> Column:
    """A repeatable identifier, so that running a job twice writes the same rows."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def map_merge(base: Column, extra: Column) -> Column:
    """``base`` with the keys of ``extra`` added or replaced."""
    return F.map_concat(
        F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k)), extra
    )


def drop_null_values(entries: dict[str, Column]) -> Column:
    """A string map of the entries that have a value."""
    pairs = [
        F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
        for k, v in entries.items()
    ]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))
