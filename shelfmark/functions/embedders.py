"""Extension point for embedding models.

An embedder maps a text column to a vector column (``embed``) and an array of texts to
the cosine distances of neighbouring texts (``neighbour_distances``, used to find topic
shifts without shipping the vectors back). Models run in Arrow UDFs: one instance per
Python worker, called with bounded batches of texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KNOWN_TOKENS = 1 << 16  # tokens whose bucket a model keeps at a time

Model = Callable[[Sequence[str]], np.ndarray]


def as_list_array(matrix: np.ndarray) -> pa.Array:
    """A 2-d float matrix as an Arrow array of equal-length lists."""
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32).ravel()))


def run_model(model: Model, texts: list[str], batch_size: int) -> np.ndarray:
    """Vectors in input order, asking the model for ``batch_size`` texts at a time."""
    parts = []
    for start in range(0, len(texts), batch_size):
        window = texts[start:start + batch_size]
        vectors = np.asarray(model(window), dtype=np.float32)
        if vectors.ndim != 2 or len(vectors) != len(window):
            raise ValueError("the model must return one vector per text")
        parts.append(vectors)
    return np.concatenate(parts) if parts else np.zeros((0, 0), dtype=np.float32)


def row_distances(vectors: np.ndarray) -> np.ndarray:
    """``1 - cosine`` of each row and its predecessor; cosine with a zero row is 0."""
    wide = vectors.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", wide, wide))
    dots = np.einsum("ij,ij->i", wide[1:], wide[:-1])
    scale = norms[1:] * norms[:-1]
    similarity = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
    return (np.float32(1.0) - similarity.astype(np.float32)).astype(np.float32)


class ModelEmbedder:
    """Any Python model ``list[str] -> 2-d array``; ``factory`` builds it on a worker."""

    def __init__(self, factory: Callable[[], Model], batch_size: int = 32) -> None:
        if batch_size <= 0:
            raise ValueError("batch_size must be > 0")
        self.factory = factory
        self.batch_size = batch_size

    def embed(self, text: Column) -> Column:
        factory, batch_size = self.factory, self.batch_size

        @F.arrow_udf("array<float>")
        def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = factory()
            for batch in batches:
                texts = [t or "" for t in batch.to_pylist()]
                yield as_list_array(run_model(model, texts, batch_size))

        # Marked so that the optimizer does not run the model again for a test of its result.
        return vectors.asNondeterministic()(text)

    def neighbour_distances(self, texts: Column) -> Column:
        factory, batch_size = self.factory, self.batch_size

        @F.arrow_udf("array<float>")
        def distances(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = factory()
            for batch in batches:
                lists = [x or [] for x in batch.to_pylist()]
                # A text alone has no neighbour, so it is not worth a model call.
                flat = run_model(model, [t for x in lists if len(x) > 1 for t in x], batch_size)
                out, at = [], 0
                for x in lists:
                    if len(x) > 1:
                        out.append(row_distances(flat[at:at + len(x)]))
                        at += len(x)
                    else:
                        out.append(np.zeros(0, dtype=np.float32))
                yield pa.array(out, type=pa.list_(pa.float32()))

        return distances(texts)


def hashing_model(dim: int) -> Model:
    """Counts of hashed tokens: the bucket is the first 32 bits of the MD5, modulo ``dim``."""
    word = re.compile(r"\w+", re.ASCII)
    buckets: dict[str, int] = {}

    def bucket(token: str) -> int:
        found = buckets.get(token)
        if found is None:
            if len(buckets) >= KNOWN_TOKENS:
                buckets.clear()
            found = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
            buckets[token] = found
        return found

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            hits = [bucket(t) for t in word.findall(text.lower())]
            if hits:
                out[i] = np.bincount(hits, minlength=dim)
        return out

    return embed


class HashingEmbedder(ModelEmbedder):
    """Deterministic bag-of-hashed-tokens vectors, needing no model files."""

    def __init__(self, dim: int = 64, batch_size: int = 4096) -> None:
        if dim <= 0:
            raise ValueError("dim must be > 0")
        super().__init__(lambda: hashing_model(dim), batch_size)
        self.dim = dim
