"""Edit-aware token counts: a segment tree of pre-token pieces for each document."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .tokens import ByteEncoder, byte_encoder

LEAF = 64  # pieces of a leaf when the tree is built
FULL = 8 * LEAF  # pieces of a leaf at which the tree is built anew


def cut(text: str) -> list[str]:
    """``text`` cut before every space that stands between two other characters; no pre-token crosses such a place."""
    if not text:
        return []
    first, *rest = text.split(" ")
    out = [first]
    for p in rest:
        if not p or p[0].isspace() or not out[-1] or out[-1][-1].isspace():
            out[-1] = f"{out[-1]} {p}"
        else:
            out.append(f" {p}")
    return out if out[0] else out[1:]


class CountTree:
    """Token count of a text that is edited.

    A leaf holds up to some hundred consecutive pieces; ``chars`` and ``tokens`` are bottom-up
    segment trees of sums over the leaves. An edit finds its leaves by descent, takes in the pieces it touches
    and as much context as keeps both outer cuts outside the changed characters,
    encodes that region only, and updates the sums on the way to the root.
    """

    def __init__(self, text: str, encoder: ByteEncoder):
        self.encoder = encoder
        self.recounted = 0
        pieces = cut(text)
        self._build(pieces, [self._count(p) for p in pieces])

    @classmethod
    def of(cls, pieces: list[str], counts: list[int], encoder: ByteEncoder) -> CountTree:
        """A tree that was kept as its pieces and their counts; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.encoder, tree.recounted = encoder, 0
        tree._build(pieces, counts)
        return tree

    def _count(self, piece: str) -> int:
        if piece[0] == " " and len(piece) > 1 and not piece[1].isspace() and " " not in piece[1:] and piece not in self.encoder.special:
            if self.encoder.special_at is None or "<" not in piece:
                return len(self.encoder.pieces[piece[1:]]) // 4
        return len(self.encoder.encode(piece)) // 4

    def _build(self, pieces: list[str], counts: list[int]) -> None:
        self.leaves = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self.counts = [counts[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (leaf, count) in enumerate(zip(self.leaves, self.counts, strict=True)):
            self.chars[self.size + k], self.tokens[self.size + k] = sum(map(len, leaf)), sum(count)
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def _set(self, k: int, leaf: list[str], count: list[int]) -> None:
        self.leaves[k], self.counts[k] = leaf, count
        k += self.size
        self.chars[k], self.tokens[k] = sum(map(len, leaf)), sum(count)
        while k := k >> 1:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds ``place`` (the last one beyond the end), and where it begins."""
        k, begin = 1, 0
        while k < self.size:
            k *= 2
            if place >= begin + self.chars[k] and self.chars[k + 1]:
                begin += self.chars[k]
                k += 1
        return min(k - self.size, len(self.leaves) - 1), begin

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace the characters from ``start`` to ``end`` (clipped to the text) by ``text``."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        a, begin = self._leaf(max(start - 2, 0))
        b, _ = self._leaf(end + 1)
        pieces = [p for leaf in self.leaves[a : b + 1] for p in leaf]
        counts = [c for count in self.counts[a : b + 1] for c in count]
        ends = list(accumulate(map(len, pieces), initial=begin))
        # the outermost pieces whose cuts lie clear of the changed characters
        low = max((k for k, e in enumerate(ends[:-1]) if e <= start - 2), default=0)
        high = min((k for k, e in enumerate(ends) if e >= end + 1 and k > low), default=len(pieces))
        if low == 0 and a and ends[0] > start - 2:
            raise AssertionError("the leaf before should have been taken in")
        region = "".join(pieces[low:high])
        at = ends[low] if pieces else begin
        fresh = cut(region[: start - at] + text + region[end - at :])
        if high == len(pieces) and b + 1 < len(self.leaves) and ends[-1] < end + 1:
            raise AssertionError("the leaf after should have been taken in")
        new = [self._count(p) for p in fresh]
        self.recounted += len(fresh)
        pieces[low:high], counts[low:high] = fresh, new
        if len(pieces) > FULL * (b - a + 1) or (not pieces and len(self.leaves) > 1):
            every = [p for leaf in (*self.leaves[:a], pieces, *self.leaves[b + 1 :]) for p in leaf]
            self._build(every, [c for count in (*self.counts[:a], counts, *self.counts[b + 1 :]) for c in count])
            return
        step = -(-len(pieces) // (b - a + 1)) or 1
        for k in range(a, b + 1):
            i = (k - a) * step
            self._set(k, pieces[i : i + step], counts[i : i + step])

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


_SCHEMA = "doc_id long, n_tokens long, n_pieces long, n_edits long, n_tokens_edited long, n_pieces_recounted long"


def _counter(path: str | None):
    def run(batches):
        encoder = byte_encoder(path)
        for batch in batches:
            out = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tree = CountTree(text or "", encoder)
                before, pieces = tree.total, sum(map(len, tree.leaves))
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                out.append((before, pieces, len(edits or ()), tree.total, tree.recounted))
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "n_pieces", "n_edits", "n_tokens_edited", "n_pieces_recounted"])

    return run


def token_counts(docs: DataFrame, edits: Column | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Token count of each whole text, and after its edits.

    ``edits`` is an array of ``struct<start int, end int, text string>``, in code points of
    the text as the edits before left it; places outside the text are clipped to it.
    Returns ``doc_id, n_tokens, n_pieces, n_edits, n_tokens_edited, n_pieces_recounted``.

    Null text is empty (0 tokens); a null edit list has no edits and a null edit changes nothing.
    Rows are independent: no shuffle, repeated rows are answered each, other columns are not looked at.
    """
    ship_package(docs.sparkSession)
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (none if edits is None else edits).alias("edits"))
    return rows.mapInArrow(_counter(path), _SCHEMA)


TREE = "doc_id long, n_tokens long, text string, lengths binary, counts binary, n_recounted long"


def _kept(doc_id, tree: CountTree) -> tuple:
    """A tree as a row: the text, and of its pieces the lengths and counts."""
    lengths = np.array([len(p) for leaf in tree.leaves for p in leaf], "<u4")
    counts = np.array([c for count in tree.counts for c in count], "<u4")
    return doc_id, tree.total, tree.text(), lengths.tobytes(), counts.tobytes(), tree.recounted


def _tree_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*[c.split() for c in TREE.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, t in enumerate(types)], names=list(names))


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The tree of each document as a row, to be written to a table: ``doc_id, n_tokens, text, lengths, counts, n_recounted`` (0).

    Null text is empty. Rows without id have a tree too, which no edit meets; ids should differ, as edits meet all rows of an id.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        encoder = byte_encoder(path)
        for batch in batches:
            yield _tree_batch([_kept(i, CountTree(t or "", encoder)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, TREE)


def edit_trees(trees: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """The trees that ``edits`` (``doc_id, place, start, end, text``, applied by ``place``) change, as rows like those of ``token_trees``.

    Edits meet the trees by id, so documents without one are not read into Python, and of the others only the regions that an
    edit touches are encoded (``n_recounted`` pieces). Places are those in the text as the edits before left it. Edits of
    unknown ids, and nulls, change nothing; edits of one place go by start, end and text.
    """
    ship_package(trees.sparkSession)
    mine = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in ("place", "start", "end", "text")])))
    asked = edits.filter("doc_id is not null").groupBy(F.col("doc_id").alias("edited")).agg(mine.alias("edits"))
    met = trees.join(asked, trees["doc_id"] == asked["edited"]).select("doc_id", "text", "lengths", "counts", "edits")

    def run(batches):
        encoder = byte_encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text, lengths, counts, todo in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                ends = list(accumulate(np.frombuffer(lengths, "<u4").tolist(), initial=0))
                tree = CountTree.of([text[a:b] for a, b in zip(ends, ends[1:], strict=False)], np.frombuffer(counts, "<u4").tolist(), encoder)
                for e in todo:
                    tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                rows.append(_kept(doc_id, tree))
            yield _tree_batch(rows)

    return met.mapInArrow(run, TREE)


def merged_trees(trees: DataFrame, changed: DataFrame) -> DataFrame:
    """The table of trees with the changed ones in the place of the old."""
    ids = changed.select(F.col("doc_id").alias("edited")).distinct()
    return trees.join(ids, trees["doc_id"] == ids["edited"], "left_anti").unionByName(changed)


def trial_edits(text_col: str = "text") -> Column:
    """Three edits for any text, by a fixed rule: a word in the middle, seven characters less at a quarter, a new end."""
    n = F.coalesce(F.length(text_col), F.lit(0))
    edit = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(t).alias("text"))
    return F.array(edit(F.floor(n / 2), F.floor(n / 2), " revised,"), edit(F.floor(n / 4), F.floor(n / 4) + 7, ""), edit(n, n + 1, "\n\nRevised edition."))
