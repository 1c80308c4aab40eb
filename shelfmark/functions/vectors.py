"""Vector arithmetic and the deterministic stand-in embedding, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

NON_WORD = r"\W+"


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the common dimensions, in double precision."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the shorter length; 0 when either norm is 0."""
    n = F.least(F.size(a), F.size(b))
    pair = F.struct(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))
    return let(
        pair,
        lambda p: let(
            norm(p["a"]) * norm(p["b"]),
            lambda d: F.when(d == 0, F.lit(0.0)).otherwise(dot(p["a"], p["b"]) / d),
        ),
    )


def token_bucket(token: Column, dim: int) -> Column:
    """Hash bucket of a token: the first 32 bits of its MD5, modulo ``dim``."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dim


def hashing_embedding(text: Column, dim: int = 64) -> Column:
    """Bag of hashed tokens as a dense float vector.

    The buckets are written into one delimited string and counted by how much the
    string shrinks when a bucket is removed, so the cost stays at ``dim`` native scans
    per text and no row is exploded or shuffled.
    """
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD), lambda t: t != "")
    marks = F.array_join(
        F.transform(tokens, lambda t: F.concat(F.lit(","), token_bucket(t, dim).cast("string"), F.lit(","))),
        "",
    )
    keys = F.array(*[F.lit(f",{i},") for i in range(dim)])
    return let(
        marks,
        lambda m: let(
            F.length(m),
            lambda n: F.transform(
                keys,
                lambda k: ((n - F.length(F.replace(m, k, F.lit("")))) / F.length(k)).cast("float"),
            ),
        ),
    )


def nearest_rank(sorted_values: Column, percentile: float) -> Column:
    """Value at rank ``ceil(p/100*n)`` of an ascending array, clamped to its ends."""
    return let(
        sorted_values,
        lambda v: F.element_at(
            v,
            F.greatest(
                F.lit(1),
                F.least(F.size(v), F.ceil(F.lit(percentile) / 100.0 * F.size(v)).cast("int")),
            ),
        ),
    )
