"""The splitter port as a table function: parts come in as rows of a document, pieces go out as rows.

A document's parts are handed over in order and in Arrow batches, so neither the parts nor the pieces of a document are
held as a whole, and each part is touched once. That is the way for documents too large for one row; smaller ones are
better cut inside their row (:mod:`~.chunking`).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vector_search import _arrow_schema


def pack_rows(parts: DataFrame, by: str, order: str, text: str, size: int, separator: str = "\n") -> DataFrame:
    """``by, piece_index, content``: parts of equal ``by``, in ``order``, joined as long as they stay within ``size``.

    A part longer than ``size`` is a piece of its own, uncut; a null part counts as an empty one.
    """
    if size <= 0:
        raise ValueError("size must be > 0")
    kind = T.StructType([T.StructField(by, parts.schema[by].dataType)]).add("piece_index", "long").add("content", "string")
    arrow = _arrow_schema(kind)

    class Pack:
        def __init__(self) -> None:
            self.held: list[str] = []
            self.length = self.index = 0
            self.key = None

        def pieces(self, texts: list[str]) -> pa.Table:
            first, self.index = self.index, self.index + len(texts)
            return pa.table([pa.array([self.key] * len(texts), arrow.field(0).type), pa.array(range(first, self.index), pa.int64()),
                             pa.array(texts, pa.string())], schema=arrow)

        def eval(self, rows: pa.RecordBatch):
            done = []
            for self.key, part in zip(rows.column(by).to_pylist(), rows.column(text).to_pylist()):
                part = part or ""
                longer = self.length + len(separator) + len(part)
                if self.held and longer > size:
                    done.append(separator.join(self.held))
                    self.held = []
                self.length = longer if self.held else len(part)
                self.held.append(part)
            if done:
                yield self.pieces(done)

        def terminate(self):
            if self.held:
                yield self.pieces([separator.join(self.held)])

    packed = F.arrow_udtf(Pack, returnType=kind)
    return packed(parts.select(by, order, text).asTable().partitionBy(by).orderBy(order))
