"""Token-id files in Simple-8b words."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, ship_package
from .tokens import byte_encoder

# Values in a word and bits of each, by selector. 14: a run of zeros; 15: escape, the next word is one value of 64 bits.
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 240, 1]
BITS = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 60]
ESCAPE, ZEROS = 15, 14
GROUP = 256  # values between two offsets; a group begins with a word of its own
SHARD_ROWS = 200_000  # documents of a shard, about, where there are more than the session's shuffle partitions hold
BLOCK = 1 << 17  # a block closes after the document that fills it
END_ID = 2


_SHORT = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(values.shape, np.uint8)
    if int(values.max()) < 1 << 16:
        return _SHORT[values.astype(np.uint16)]
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(step)
        bits[big] += step
        rest[big] >>= np.uint64(step)
    return bits + (rest > 0)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words, offsets)``: 64-bit words, and for each group of 256 values the place of its first word.

    Every word is filled greedily, as Simple-8b does, in all groups at once:
    first the most values that fit from each place, then one word a step in every group.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    values = np.ascontiguousarray(values, np.uint64)
    groups = -(-n // GROUP)
    width = GROUP + 1
    bits = np.full((groups, width), 99, np.uint8)  # the last column ends a group
    flat = np.full(groups * GROUP, 99, np.uint8)
    flat[:n] = _bit_lengths(values)
    bits[:, :GROUP] = flat.reshape(groups, GROUP)
    bits = bits.reshape(-1)
    choice = np.where(bits > 60, np.uint8(ESCAPE), np.uint8(13))
    # a selector with more values fits only where the one before it does: the first few look everywhere, the others where those fit
    high, seen = bits.copy(), 1
    for s in (12, 11, 10):
        for k in range(seen, COUNTS[s]):
            np.maximum(high[:-k], bits[k:], out=high[:-k])
            high[-k:] = 99
        seen = COUNTS[s]
        choice[high <= BITS[s]] = s
    at = np.flatnonzero(high <= BITS[9])
    high = high[at]
    for s in range(9, -1, -1):
        for k in range(seen, COUNTS[s]):
            high = np.maximum(high, bits[np.minimum(at + k, len(bits) - 1)])
        seen = COUNTS[s]
        fits = high <= BITS[s]
        at, high = at[fits], high[fits]
        if not len(at):
            break
        choice[at] = s
    if len(at):
        zero = np.concatenate([[0], np.cumsum(bits != 0)])
        at = at[at + COUNTS[ZEROS] < len(zero)]
        choice[at[zero[at + COUNTS[ZEROS]] == zero[at]]] = ZEROS
    jump = np.array(COUNTS, np.int64)[choice]
    # walk all groups at once
    ends = np.minimum(np.arange(1, groups + 1) * GROUP, n) - np.arange(groups) * GROUP + np.arange(groups) * width
    place = np.arange(groups, dtype=np.int64) * width
    begins = np.zeros(len(bits), bool)
    end = ends
    while len(place):
        begins[place] = True
        place = place + jump[place]
        on = place < end
        if not on.all():
            place, end = place[on], end[on]
    start = np.flatnonzero(begins)
    sel = choice[start]
    source = start - start // width  # places in ``values``
    size = 1 + (sel == ESCAPE)
    out_at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(16):
        m = np.flatnonzero(sel == s)
        if not len(m):
            continue
        w = np.full(len(m), s << 60, np.uint64)
        if s == ESCAPE:
            words[out_at[m] + 1] = values[source[m]]
        elif s != ZEROS:
            for k in range(COUNTS[s]):
                w |= values[source[m] + k] << np.uint64(k * BITS[s])
        words[out_at[m]] = w
    first = np.searchsorted(start, np.arange(groups) * width)
    return words, out_at[first].astype(np.uint32)


def decode(words: np.ndarray) -> np.ndarray:
    """The values of ``words``, selector by selector; they must begin where a group does."""
    if not len(words):
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.uint8)
    own = np.ones(len(words), bool)
    marks = np.flatnonzero(sel == ESCAPE)
    last = -1
    for k in marks.tolist():  # rare: a word after an escape is a value whatever its top bits say
        if k != last:
            own[k + 1] = False
            last = k + 1
    heads = np.flatnonzero(own)
    sel = sel[heads]
    counts = np.array(COUNTS, np.int64)[sel]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(16):
        m = np.flatnonzero(sel == s)
        if not len(m) or s == ZEROS:
            continue
        if s == ESCAPE:
            out[at[m]] = words[heads[m] + 1]
            continue
        w = words[heads[m]]
        mask = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            out[at[m] + k] = (w >> np.uint64(k * BITS[s])) & mask
    return out


_BLOCKS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int64()), ("start_in_shard", pa.int64()), ("n_ids", pa.int64()),
     ("doc_ids", pa.binary()), ("no_id", pa.binary()), ("doc_lengths", pa.binary()), ("offsets", pa.binary()), ("words", pa.binary())]
)
_BLOCKS_DDL = "shard int, block long, start_in_shard long, n_ids long, doc_ids binary, no_id binary, doc_lengths binary, offsets binary, words binary"


def _writer(path: str | None, end_id: int):
    def write(batches):
        encoder, end = byte_encoder(path), int(end_id).to_bytes(4, "little")
        parts, ids, lengths, held, block, start, shard = [], [], [], 0, 0, 0, None

        def close():
            nonlocal parts, ids, lengths, held, block, start
            values = np.frombuffer(b"".join(parts), "<u4")
            words, offsets = encode(values)
            row = [shard, block, start, len(values), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], "u1").tobytes(),
                   np.array(lengths, "<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()]
            batch = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)
            start += len(values)
            parts, ids, lengths, held, block = [], [], [], 0, block + 1
            return batch

        for batch in batches:
            for s, i, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if shard is not None and s != shard and held:
                    yield close()
                if s != shard:
                    shard, block, start = s, 0, 0
                got = encoder.encode(text) + end
                parts.append(got)
                ids.append(i)
                lengths.append(len(got) // 4)
                held += len(got) // 4
                if held >= BLOCK:
                    yield close()
        if held:
            yield close()

    return write


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, to: str | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, and write the ids in ascending id order; returns a reader of the files.

    ``to`` is the folder that they are written to, on any store; it must not exist. Without it they are scratch files
    that go with the application. ``path`` names the tokenizer.

    A file is a Parquet container, so that Spark's committer guards against lost and repeated tasks on any store.
    A row is a block: ids of its documents and their lengths, group offsets and Simple-8b words.
    ``shard`` orders the blocks, then ``block``. A shard is a range of ids and, within one id, of text hashes, with some
    ``SHARD_ROWS`` rows at most, so that neither the size of the table nor an id that very many rows share (or lack) fills one task.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD_ROWS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    placed = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    blocks = placed.mapInArrow(_writer(path, end_id), _BLOCKS_DDL)
    if to is None:
        return materialise(blocks, "token-ids")
    blocks.write.option("compression", "zstd").parquet(to)
    return open_token_files(spark, to)


def open_token_files(spark: SparkSession, at: str) -> DataFrame:
    """The blocks of files that ``write_token_files`` left in a folder; ``read_token_files`` and ``document_ids`` decode them."""
    return spark.read.schema(_BLOCKS_DDL).parquet(at)


_DOCS_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _reader(base: dict[int, int]):
    def read(batches):
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                shard, _, start, n, doc_ids, no_id, lengths, _, words = row
                values = decode(np.frombuffer(words, "<u8"))
                if len(values) != n:
                    raise ValueError(f"block of {n} ids decodes to {len(values)}")
                raw = memoryview(values.astype("<u4").tobytes())
                lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                ids = pa.array(np.frombuffer(doc_ids, "<i8"), pa.int64(), mask=np.frombuffer(no_id, "u1").astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(ends - lengths + start + base[shard]), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the files."""
    totals = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # one row a shard
    base, at = {}, 0
    for s in sorted(totals):
        base[s], at = at, at + totals[s]
    ordered = files.select("shard", "block", "start_in_shard", "n_ids", "doc_ids", "no_id", "doc_lengths", "offsets", "words")
    return ordered.mapInArrow(_reader(base), _DOCS_DDL)


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and answer from them: ``doc_id, start, n_tokens, ids_crc32``.

    Null and empty texts hold the end id alone. Rows without an id come first. Rows of one id are
    ordered by a hash of their text, and each has its own place. An empty table gives no rows.
    """
    return read_token_files(write_token_files(docs, id_col, text_col, path))


def document_ids(block: dict, doc_id: int) -> np.ndarray | None:
    """Ids of one document of a block row, decoded from the groups that hold it; None if it is not there."""
    hit = np.flatnonzero(np.frombuffer(block["doc_ids"], "<i8") == doc_id)
    if not len(hit):
        return None
    lengths = np.frombuffer(block["doc_lengths"], "<u4").astype(np.int64)
    start = int(lengths[: hit[0]].sum())
    end = start + int(lengths[hit[0]])
    offsets, words = np.frombuffer(block["offsets"], "<u4"), np.frombuffer(block["words"], "<u8")
    a, b = start // GROUP, -(-end // GROUP)
    stop = int(offsets[b]) if b < len(offsets) else len(words)
    return decode(words[int(offsets[a]) : stop])[start - a * GROUP : end - a * GROUP].astype(np.uint32)
