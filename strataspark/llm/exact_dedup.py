"""Exact deduplication with a sharded cuckoo-filter index."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship_package
from .names import free_names

SLOTS = 4
KEYS_PER_SHARD = 100_000
PARTIAL_KEYS = 100_000
WHITE = "[\\x20\\x09-\\x0D]+"


class CuckooIndex:
    """Cuckoo filter over digests, with the live records behind it.

    A digest has a 16-bit fingerprint and two buckets, each found from the
    other by partial-key hashing. A fingerprint hit is only a hint: the record
    itself (digest and byte length) is compared in the content bucket of the
    digest, so a false positive never merges two texts. When no slot comes free
    within ``max_kicks`` moves, or the load passes 0.9, the table doubles and is filled
    again from the stored keys.
    """

    max_kicks = 200

    def __init__(self, buckets: int = 1024):
        self.bits = max(1, (max(2, buckets) - 1).bit_length())
        self.hits = self.false_hits = self.resizes = 0
        self._clear()
        self.live = 0

    def _clear(self) -> None:
        self.mask = (1 << self.bits) - 1
        self.slots = array("H", bytes(2 * SLOTS << self.bits))
        self.content: dict[int, list[list]] = {}

    def _place(self, digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[2:10], "little") & self.mask, int.from_bytes(digest[:2], "little") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x9E3779B1)) & self.mask

    def _holds(self, bucket: int, mark: int) -> bool:
        return mark in self.slots[bucket * SLOTS : bucket * SLOTS + SLOTS]

    def find(self, digest: bytes, length: int) -> list | None:
        """The live record ``[digest, length, keep_id, count]``, or None."""
        bucket, mark = self._place(digest)
        if not (self._holds(bucket, mark) or self._holds(self._other(bucket, mark), mark)):
            return None
        self.hits += 1
        for record in self.content.get(bucket, ()):
            if record[0] == digest and record[1] == length:
                return record
        self.false_hits += 1
        return None

    def add(self, digest: bytes, length: int, keep_id: int | None, count: int = 1) -> bool:
        """Insert or count once more; True if the digest is new."""
        record = self.find(digest, length)
        if record is not None:
            if keep_id is not None and (record[2] is None or keep_id < record[2]):
                record[2] = keep_id
            record[3] += count
            return False
        self._insert([digest, length, keep_id, count])
        return True

    def _insert(self, record: list) -> None:
        bucket, mark = self._place(record[0])
        self.content.setdefault(bucket, []).append(record)
        self.live += 1
        if self.live > 0.9 * SLOTS * (self.mask + 1) or not self._settle(bucket, mark):
            self._grow()

    def _settle(self, bucket: int, mark: int) -> bool:
        slots = self.slots
        for at in (bucket, self._other(bucket, mark)):
            for k in range(at * SLOTS, at * SLOTS + SLOTS):
                if not slots[k]:
                    slots[k] = mark
                    return True
        at = self._other(bucket, mark)
        for turn in range(self.max_kicks):
            k = at * SLOTS + (turn * 7 + mark) % SLOTS
            slots[k], mark = mark, slots[k]
            at = self._other(at, mark)
            for j in range(at * SLOTS, at * SLOTS + SLOTS):
                if not slots[j]:
                    slots[j] = mark
                    return True
        return False

    def _grow(self) -> None:
        """Double the table and settle every stored key anew."""
        records = list(self.records())
        while True:
            self.bits += 1
            self.resizes += 1
            self._clear()
            for r in records:
                self.content.setdefault(self._place(r[0])[0], []).append(r)
            # more equal fingerprints than two buckets hold can only come of equal leading bytes; let the table stop growing then
            if all(self._settle(*self._place(r[0])) for r in records):
                return
            if self.bits > 28:
                raise OverflowError("cuckoo index cannot place its keys")

    def remove(self, digest: bytes, length: int, count: int | None = None) -> bool:
        """Delete ``count`` copies (all if None); the fingerprint leaves with the last. False if not live."""
        record = self.find(digest, length)
        if record is None:
            return False
        record[3] -= record[3] if count is None else min(count, record[3])
        if record[3] == 0:
            bucket, mark = self._place(digest)
            rest = [r for r in self.content[bucket] if r is not record]
            if rest:
                self.content[bucket] = rest
            else:
                del self.content[bucket]
            for at in (bucket, self._other(bucket, mark)):
                if self._holds(at, mark):
                    self.slots[at * SLOTS + self.slots[at * SLOTS : at * SLOTS + SLOTS].index(mark)] = 0
                    break
            self.live -= 1
        return True

    def records(self) -> Iterator[list]:
        for bucket in self.content.values():
            yield from bucket

    def __len__(self) -> int:
        return self.live


_FIELDS = pa.schema([("digest", pa.binary()), ("length", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64())])
_DDL = "digest binary, length long, keep_id long, n long"


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.records())
    for i in range(0, len(rows), 20_000):
        part = rows[i : i + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], f.type) for k, f in enumerate(_FIELDS)], schema=_FIELDS)


def _columns(batch: pa.RecordBatch) -> Iterable[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _partial(batches):
    """One record for each distinct digest of a task: a text with very many copies leaves one row a task."""
    index = CuckooIndex()
    for batch in batches:
        for doc_id, digest, length in _columns(batch):
            index.add(digest, length, doc_id)
        if len(index) >= PARTIAL_KEYS:
            yield from _emit(index)
            index = CuckooIndex()
    yield from _emit(index)


def _merge(batches):
    index = CuckooIndex()
    for batch in batches:
        for digest, length, keep_id, n in _columns(batch):
            index.add(digest, length, keep_id, n)
    yield from _emit(index)


def _merge_signed(batches):
    """As ``_merge``; deletions (negative counts) are applied after all insertions of the shard."""
    index, gone = CuckooIndex(), []
    for batch in batches:
        for digest, length, keep_id, n in _columns(batch):
            if n < 0:
                gone.append((digest, length))
            else:
                index.add(digest, length, keep_id, n)
    for digest, length in gone:
        index.remove(digest, length)
    yield from _emit(index)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, length`` of the normalised text; null counts as empty."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).select(
        "doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").cast("long").alias("length")
    )


def _shards(n: int) -> int:
    return max(8, math.ceil(n / KEYS_PER_SHARD))


def build_index(base: DataFrame) -> DataFrame:
    """Index table ``digest, length, keep_id, n`` of ``digests()`` rows, one row for each live digest."""
    ship_package(base.sparkSession)
    partial = base.select("doc_id", "digest", "length").mapInArrow(_partial, _DDL)
    return partial.repartition(_shards(base.count()), "digest").mapInArrow(_merge, _DDL)


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after ``inserted`` documents (``digests()`` rows) came and ``deleted`` digests (``digest, length``) went.

    A digest in both is gone afterwards. Deleting a digest that is not live does nothing.
    """
    ship_package(index.sparkSession)
    came = inserted.select("doc_id", "digest", "length").mapInArrow(_partial, _DDL)
    went = deleted.select("digest", "length").distinct().select("digest", "length", F.lit(None).cast("long").alias("keep_id"), F.lit(-1).cast("long").alias("n"))
    rows = index.select("digest", "length", "keep_id", "n").unionByName(came).unionByName(went)
    return rows.repartition(_shards(index.count()), "digest").mapInArrow(_merge_signed, _DDL)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of white space became one
    space; the smallest ``doc_id`` of equal texts stays. Null text is the empty
    text. Rows without an id never win over one with an id. A repeated row
    (same id and text) counts in ``group_size`` and is marked as its twin is;
    ``keep_first`` leaves one of them. Other columns are not looked at.

    The text leaves the scan as a digest only. A very frequent digest is counted
    within each task first; the way back to the documents is an ordinary join on
    the digest, which adaptive execution splits where one digest fills a partition.
    """
    base = materialise(digests(docs, id_col, text_col), "exact-digests")
    groups = build_index(base).select("digest", "length", "keep_id", F.col("n").alias("group_size"))
    return base.join(groups, ["digest", "length"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns; of repeated rows one stays.

    The decision joins back on id and digest (of rows that stay, against all rows), so rows that share an id, or have
    none, are told apart by their texts. Of equal texts without any id one row stays.
    """
    marked = exact_dedup(docs, id_col, text_col)
    kept = marked.filter("kept").groupBy("doc_id", F.unhex("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n"))
    keep, sha, n, own, digest = free_names(docs, "__keep", "__sha", "__n", "__id", "__digest")
    kept = materialise(kept.select(F.col("doc_id").alias(keep), F.col("sha").alias(sha), F.col("n").alias(n)), "exact-kept")
    text = F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " "), 256))
    rows = docs.withColumns({own: F.col(id_col).cast("long"), digest: text})
    stays = (F.col(digest) == F.col(sha)) & F.col(own).eqNullSafe(F.col(keep))
    out = rows.join(kept.select(keep, sha), stays, "left_semi")
    if not kept.filter(F.col(n) > 1).isEmpty():
        out = out.dropDuplicates([own, digest])
    return out.drop(own, digest)


def exact_dedup_sql() -> str:
    return r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
