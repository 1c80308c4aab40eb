"""SentencePiece encoding and decoding with the N best segmentations.

A text, normalised by the model, is a lattice whose edges are vocabulary pieces. A forward Viterbi pass
gives the least cost from the start to every position. Searching backwards from the end, that cost is an exact
estimate of what is left, so A-star takes the complete paths off its queue in order of cost.

Where no piece can cross a position, the lattice falls into independent units (words, mostly). Units that come
again are kept by the worker, and the others of some texts are solved together, position by position. Costs add up over units, so only the units with the ``n - 1`` least second-best
losses can differ in the ``n`` best segmentations of a text; only they are searched further, and merged exactly.

Costs are integers (thousandths of a nat), so equal costs are equal. The scores of a unigram model are log
probabilities and are used as they are. The scores of a BPE model are merge ranks, not probabilities: there every
piece costs the log of the vocabulary's size, and up to one nat more the later it was merged. A character
without a piece is spelled in byte pieces.

Defined results: a null or empty text has no pieces, cost 0 and one segmentation; ties go to the
segmentation the search meets first, the same in every run; with fewer than ``n`` segmentations all are given.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEPT, Cached, Frequent, IntTable, small_batches, texts

N_BEST = 4
UNIT_CACHE = 1 << 18
TOGETHER = 2 << 20   # bytes of texts whose units are solved at once
GROUP = 1 << 13      # of them in one go, so that the arrays stay in the processor's cache
SHORT = 32           # longer units are solved one by one
FAR = 1 << 60
_NONE = ({}, None, 0)

_EDITS = "array<struct<at:int,drop:int,put:array<int>>>"
SCHEMA = f"n_pieces long, cost long, ids array<int>, exact boolean, nbest array<struct<rank:int,cost:long,n_pieces:int,edits:{_EDITS}>>"
_EDIT_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("put", pa.list_(pa.int32()))]))
_NBEST_TYPE = pa.list_(pa.struct([("rank", pa.int32()), ("cost", pa.int64()), ("n_pieces", pa.int32()), ("edits", _EDIT_TYPE)]))


class Lattice:
    """Segmentations of units under one model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        usable = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        scores = [sp.get_score(i) for i in usable]
        size = len(ids)
        if all(s == int(s) for s in scores):
            cost = [round(1000 * (math.log(size) + min(-s, size) / size)) for s in scores]
            self.spelled = round(1000 * (math.log(size) + 1))
        else:
            cost = [round(-1000 * s) for s in scores]
            self.spelled = max(cost) + 10_000
        self.pieces = {sp.id_to_piece(i): (i, c) for i, c in zip(usable, cost)}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        starts = {p[:k] for p in self.pieces for k in range(1, len(p))}
        # Everything a scan may meet: ids and cost of a piece, and whether a longer piece begins so.
        self.table = {p: (None, 0, True) for p in starts} | {
            p: ((i,), c, p in starts) for p, (i, c) in self.pieces.items()}
        # The same by character: what follows, and the ids and cost of the piece that ends here.
        self.trie: dict[str, tuple] = {}
        for p in sorted(self.pieces, key=len):
            self._plant(p)
        self._flatten()
        self.longest = max(map(len, self.pieces), default=1)
        crossing = any(re.search("[^▁]▁", p) for p in self.pieces)
        lines = not any("\n" in p for p in self.pieces)
        self.units = re.compile("(?s).+" if crossing else "\n|▁+[^▁\n]*|[^▁\n]+" if lines else "▁+[^▁]*|[^▁]+")
        self.plain = lines and not crossing
        self.raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).encode() for i in ids]
        # What the model puts before a text to mark the start of a word.
        self.prefix = sp.normalize("a")[:-1]

    def _plant(self, piece: str) -> None:
        node = self.trie
        for c in piece[:-1]:
            node = node.setdefault(c, ({}, None, 0))[0]
        i, cost = self.pieces[piece]
        node[piece[-1]] = (node[piece[-1]][0] if piece[-1] in node else {}, (i,), cost)

    def _flatten(self) -> None:
        """The trie as arrays: characters by number, nodes by the key ``node * characters + character``, a piece and its cost by node."""
        characters = sorted({c for p in self.pieces for c in p})
        self.number = np.full(0x110000, len(characters), dtype=np.int32)
        self.number[[ord(c) for c in characters]] = np.arange(len(characters))
        self.kinds = len(characters) + 1
        keys, piece, cost, open_ = [], [-1], [0], [(0, self.trie)]
        while open_:
            node, following = open_.pop()
            for c, (deeper, ids, price) in following.items():
                keys.append(node * self.kinds + int(self.number[ord(c)]))
                piece.append(-1 if ids is None else ids[0])
                cost.append(price)
                if deeper:
                    open_.append((len(keys), deeper))
        self.piece, self.cost = np.array(piece, dtype=np.int32), np.array(cost, dtype=np.int64)
        self.nodes = IntTable(np.array(keys, dtype=np.uint64), np.arange(1, len(keys) + 1))

    def units_of(self, normal: str) -> list[str]:
        """The independent units of a normalised text, in their order."""
        if not self.plain or "▁▁" in normal or "\0" in normal:
            return self.units.findall(normal)
        # Cut before every mark and on both sides of every line end, which is quicker.
        cut = normal.replace("▁", "\0▁")
        if "\n" in cut:
            cut = cut.replace("\n", "\0\n\0").replace("\0\0", "\0")
        cut = cut.strip("\0")
        return cut.split("\0") if cut else []

    def spell(self, character: str) -> tuple[int, ...]:
        """Ids for a character that is no piece."""
        spelled = character.encode("utf-8", "surrogatepass")
        return tuple(self.bytes.get(b, self.unknown) for b in spelled) if self.bytes else (self.unknown,)

    def edges(self, unit: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each end position the edges (start, cost, ids)."""
        n, table = len(unit), self.table
        into: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                ids, cost, more = table.get(unit[i:j], (None, 0, False))
                if ids is None and j == i + 1:
                    ids = self.spell(unit[i])
                    cost = self.spelled * len(ids)
                if ids is not None:
                    into[j].append((i, cost, ids))
                if not more:
                    break
        return into

    def forward(self, into: list) -> tuple[list[int], list]:
        best, back = [0] * len(into), [None] * len(into)
        for j in range(1, len(into)):
            best[j], back[j] = min(((best[e[0]] + e[1], e) for e in into[j]), key=lambda x: x[0])
        return best, back

    def solve(self, unit: str) -> tuple[tuple[int, ...], int, int]:
        """Best ids, their cost, and what the second-best segmentation costs more (-1: there is none).

        One forward pass keeps the least and the second-least cost of every position.
        """
        root, n, longest = self.trie, len(unit), self.longest
        best, second = [FAR] * (n + 1), [FAR] * (n + 1)
        back: list = [None] * (n + 1)
        best[0] = 0
        for i in range(n):
            one, two, j, node = best[i], second[i], i, root
            if root.get(unit[i], _NONE)[1] is None:
                ids = self.spell(unit[i])
                cost = self.spelled * len(ids)
                c, old = one + cost, best[i + 1]
                if c < old:
                    second[i + 1] = min(old, two + cost)
                    best[i + 1], back[i + 1] = c, (i, ids)
                elif c < second[i + 1]:
                    second[i + 1] = c
            for character in unit[i:i + longest]:
                hit = node.get(character)
                if hit is None:
                    break
                node, ids, cost = hit
                j += 1
                if ids is not None:
                    c = one + cost
                    old = best[j]
                    if c < old:
                        two_ = two + cost
                        second[j] = old if old < two_ else two_
                        best[j], back[j] = c, (i, ids)
                    elif c < second[j]:
                        second[j] = c
        ids, j = [], n
        while j:
            j, part = back[j]
            ids.append(part)
        return tuple(chain.from_iterable(reversed(ids))), best[n], second[n] - best[n] if second[n] < FAR // 2 else -1

    def packed(self, unit: str) -> tuple[bytes, int, int]:
        """:meth:`solve` with the ids as 32-bit numbers, which take less memory."""
        ids, cost, loss = self.solve(unit)
        return array("i", ids).tobytes(), cost, loss

    def packed_all(self, units: list[str]) -> list[tuple[bytes, int, int]]:
        """:meth:`packed` of all units. The short ones are solved together: first all edges, one character deeper
        at a time, then the two least costs of every position, those of one offset and one length of edges at a time."""
        if not self.pieces:
            return [self.packed(u) for u in units]
        if len(units) > GROUP:
            return list(chain.from_iterable(self.packed_all(units[a:a + GROUP]) for a in range(0, len(units), GROUP)))
        short = [u for u in units if len(u) <= SHORT]
        lengths = np.fromiter(map(len, short), dtype=np.int64, count=len(short))
        # A unit has a place for each of its characters and one for its end.
        first = np.cumsum(lengths + 1) - lengths - 1
        code = np.frombuffer("\n".join([*short, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        number = self.number[code]
        inside = np.ones(len(code), dtype=bool)
        inside[first + lengths] = False
        number[~inside] = self.kinds - 1
        offset = np.arange(len(code)) - np.repeat(first, lengths + 1)

        at, node, edges = np.flatnonzero(inside), np.zeros(int(inside.sum()), dtype=np.int64), []
        for depth in range(1, self.longest + 1):
            node = self.nodes.values[self.nodes.find((node * self.kinds + number[at + depth - 1]).astype(np.uint64))]
            whole = np.flatnonzero(self.piece[node] >= 0)
            if depth == 1:
                spelled = at[self.piece[node] < 0]
            edges.append((at[whole], np.full(len(whole), depth), self.piece[node[whole]], self.cost[node[whole]]))
            more = np.flatnonzero(node)
            at, node = at[more], node[more]
        odd, which = np.unique(code[spelled], return_inverse=True)
        spellings = [self.spell(chr(c)) for c in odd]
        sizes = np.array([len(x) for x in spellings], dtype=np.int64)
        # A spelled character is an edge with the number of its spelling, below zero.
        edges.append((spelled, np.ones(len(spelled), dtype=np.int64), -1 - which.reshape(-1), self.spelled * sizes[which.reshape(-1)]))
        start, depth, piece, cost = (np.concatenate(x) for x in zip(*edges))
        step = offset[start] * (self.longest + 1) + depth
        # Numbers of 16 bits are sorted by counting.
        order = np.argsort(step.astype(np.uint16) if SHORT * (self.longest + 1) < 1 << 16 else step, kind="stable")
        start, depth, piece, cost, step = start[order], depth[order], piece[order], cost[order], step[order]
        best, second = np.full((2, len(code)), FAR, dtype=np.int64)
        back = np.zeros(len(code), dtype=np.int64)
        best[first] = 0
        bounds = [*np.flatnonzero(np.diff(step, prepend=-1)).tolist(), len(step)]
        for a, b in zip(bounds, bounds[1:]):
            s = start[a:b]
            e, c = s + depth[a], best[s] + cost[a:b]
            old, other = best[e], second[e]
            lower = c < old
            second[e] = np.where(lower, np.minimum(old, second[s] + cost[a:b]), np.minimum(other, c))
            best[e] = np.minimum(old, c)
            back[e] = np.where(lower, np.arange(a, b), back[e])

        end, unit, parts = first + lengths, np.arange(len(short)), []
        place = end.copy()
        while len(unit):
            edge = back[place]
            parts.append((unit, edge))
            place = start[edge]
            more = place > first[unit]
            unit, place = unit[more], place[more]
        unit, edge = (np.concatenate(x[::-1]) for x in zip(*parts)) if parts else (np.array([], np.int64),) * 2
        order = np.argsort(unit, kind="stable")
        unit, found = unit[order], piece[edge[order]]
        width = np.ones(len(found), dtype=np.int64)
        width[found < 0] = sizes[-1 - found[found < 0]]
        ids = np.repeat(found, width)
        ids[ids < 0] = list(chain.from_iterable(spellings[-1 - k] for k in found[found < 0].tolist()))
        ends = 4 * np.cumsum(np.bincount(unit, width, len(short)).astype(np.int64))
        flat, loss = ids.astype(np.int32).tobytes(), second[end] - best[end]
        loss[second[end] >= FAR // 2] = -1
        solved = zip([flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())], best[end].tolist(), loss.tolist())
        return list(solved) if len(short) == len(units) else [next(solved) if len(u) <= SHORT else self.packed(u) for u in units]

    def nbest(self, unit: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` cheapest segmentations as (cost, ids), by backward A-star.

        Of equal partial paths the newest is opened first, so a unit with many ties is followed to its start at once. The
        estimates are exact, so a position comes off the queue by its cheapest ways to the end; no more than ``n`` of them matter.
        """
        into = self.edges(unit)
        best, _ = self.forward(into)
        queue = [(best[-1], 0, len(unit), 0, ())]
        found, order, opened = [], 0, [0] * (len(unit) + 1)
        while queue and len(found) < n:
            total, _, j, done, tail = heapq.heappop(queue)
            opened[j] += 1
            if j and opened[j] > n:
                continue
            if not j:
                flat = []
                while tail:
                    flat.extend(tail[0])
                    tail = tail[1]
                found.append((total, tuple(flat)))
                continue
            for i, c, ids in into[j]:
                order -= 1
                heapq.heappush(queue, (done + c + best[i], order, i, done + c, (ids, tail)))
        return found

    def decode(self, ids) -> str:
        """The text of ids; the mark of the first word goes, as the model put it there."""
        return self.shown(b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace"))

    def shown(self, normal: str) -> str:
        """A normalised text as it is read."""
        return normal.removeprefix(self.prefix).replace("▁", " ")


def _alternatives(units: list[str], loss: np.ndarray, before: np.ndarray, total: int, n: int, searched: Cached) -> list[dict]:
    """The ``n`` best segmentations of a text as changes to its best one; the ids of unit ``u`` begin at ``before[u]``, the end included."""
    chosen = np.arange(len(loss))
    if len(loss) >= n:
        # The units with the n - 1 least losses, the first ones where losses are equal.
        bound = np.partition(loss, n - 2)[n - 2] if n > 1 else -1
        under, equal = np.flatnonzero(loss < bound), np.flatnonzero(loss == bound)
        chosen = np.concatenate([under, equal[:n - 1 - len(under)]])
    kept: list[tuple[int, tuple]] = [(0, ())]
    for u in sorted(chosen[loss[chosen] < FAR].tolist()):
        choices = searched[units[u]]
        kept = heapq.nsmallest(n, ((cost + choice[0] - choices[0][0], edits if not k else edits + ((u, choice[1]),))
                                   for cost, edits in kept for k, choice in enumerate(choices)), key=lambda x: x[0])
    out, first, pieces = [], int(before[0]), int(before[-1] - before[0])
    for rank, (cost, edits) in enumerate(kept, 1):
        changes = [{"at": int(before[u]) - first, "drop": int(before[u + 1] - before[u]), "put": list(ids)} for u, ids in edits]
        out.append({"rank": rank, "cost": total + cost, "n_pieces": pieces + sum(len(c["put"]) - c["drop"] for c in changes), "edits": changes})
    return out


def _solver(path: str, n: int) -> tuple[Lattice, Cached, Cached]:
    """The model and the units solved so far; a worker keeps them from task to task of this operator."""
    kept = KEPT.setdefault("pieces", {})
    if (path, n) not in kept:
        lattice = Lattice(path)
        kept[path, n] = lattice, Frequent(lattice.packed, UNIT_CACHE, lattice.packed_all), Cached(lambda unit: lattice.nbest(unit, n), 1 << 14)
    return kept[path, n]


def encode(docs: DataFrame, path: str | None = None, n: int = N_BEST) -> DataFrame:
    """``doc_id`` with the pieces of the best segmentation, their cost, whether decoding them gives the text
    back, and the ``n`` best segmentations as edits of the best (``at``: index in ``ids``); one narrow pass.

    Only spaces written as U+2581 in the text do not come back.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        lattice, cache, searched = _solver(path or public_tokenizers.path("piece_bpe_32k.model"), n)
        for batch in small_batches(batches, "text", TOGETHER, keeps="pieces"):
            split, same = [], []
            for text in batch.column("text").to_pylist():
                normal = lattice.model.normalize(text)
                split.append(lattice.units_of(normal))
                same.append(lattice.shown(normal) == text)
            # What is known of each distinct unit as arrays, and the units of all texts as places in these.
            known = cache.values_of(set(chain.from_iterable(split)))
            parts, cost, loss = zip(*known.values()) if known else ((), (), ())
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
            cost, loss = np.array(cost, dtype=np.int64), np.array(loss, dtype=np.int64)
            loss[loss < 0] = FAR
            places = dict(zip(known, range(len(known))))
            ends = np.cumsum([0, *map(len, split)])
            units = np.fromiter(map(places.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(ends[-1]))
            before = np.concatenate([[0], np.cumsum(sizes[units])])
            starts = np.cumsum(sizes) - sizes
            ids = np.frombuffer(b"".join(parts), np.int32)[np.arange(before[-1]) + np.repeat(starts[units] - before[:-1], sizes[units])]
            costs, strange = (np.concatenate([[0], np.cumsum(x)]) for x in (cost[units], ids == lattice.unknown))
            costs, strange = np.diff(costs[ends]).tolist(), np.diff(strange[before[ends]]).tolist()
            loss = loss[units]
            # Pieces and bytes spell what was normalised; only the unknown piece, longer than any character, does not.
            exact = [whole and not odd for whole, odd in zip(same, strange)]
            best = [_alternatives(mine, loss[a:b], before[a:b + 1], total, n, searched) for mine, a, b, total in zip(split, ends[:-1], ends[1:], costs)]
            offsets, counts = pa.array(before[ends].astype(np.int32)), np.diff(before[ends])
            ids = pa.ListArray.from_arrays(offsets, pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(costs, pa.int64()), ids,
                 pa.array(exact, pa.bool_()), pa.array(best, _NBEST_TYPE)],
                names=["doc_id", "n_pieces", "cost", "ids", "exact", "nbest"])

    return texts(docs).select("doc_id", "text").mapInArrow(run, f"doc_id long, {SCHEMA}")


def segmentation(ids: Column, edits: Column) -> Column:
    """The ids of an alternative segmentation."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids"))
    done = F.aggregate(edits, start, lambda a, e: F.struct(
        (e["at"] + e["drop"]).alias("at"),
        F.concat(a["ids"], F.slice(ids, a["at"] + 1, e["at"] - a["at"]), e["put"]).alias("ids")))
    return F.concat(done["ids"], F.slice(ids, done["at"] + 1, F.greatest(F.lit(0), F.size(ids) - done["at"])))


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``doc_id`` and the ``text`` of its ids; null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        lattice = Lattice(path or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if x is None else lattice.decode(x) for x in batch.column(1).to_pylist()], pa.string())],
                names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col(ids).cast("array<int>")).mapInArrow(run, "doc_id long, text string")
