"""Filter interaction audit: how five quality filters overlap, in every order, from packed bitmaps."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship_package

FILTERS = "ABCDE"
BLANK = r"[\x20\x09-\x0D]+"
SUBSETS = 1 << len(FILTERS)
FLUSH = 1024  # parts whose sums a task holds before it hands them on


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, digest, a, b, c, d`` of each row: what each filter but E says of the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("doc_id", "part", "t", F.array_remove(F.split("t", BLANK, -1), "").alias("words"))
    capitals = F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return rows.select(
        "doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"),
        (F.size("words") < 100).alias("a"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 80 * F.size("words").cast("long")).alias("b"),
        (100 * capitals.cast("long") > 10 * F.length("t").cast("long")).alias("c"),
        F.col("t").rlike(r"[#$%&*|]").alias("d"),
    )


def with_copies(rows: DataFrame) -> DataFrame:
    """Adds ``e``: the text is that of a row with a smaller id, anywhere in the table.

    The first row of each text comes from one aggregate that combines before the shuffle, and meets the rows on their id,
    so a text that a third of the rows repeat leaves no hot key in the join.
    """
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("digest", "first_digest")
    on = (rows["doc_id"] == first["first_id"]) & (rows["digest"] == first["first_digest"])
    return rows.join(first, on, "left").withColumn("e", F.col("doc_id").isNotNull() & F.col("first_id").isNull()).drop("first_id", "first_digest")


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``good`` and ``toxic``: some label of the id has quality 1, toxic 1."""
    held = labels.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    both = rows.join(held, rows["doc_id"] == held["label_id"], "left").drop("label_id")
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})


INDEX = "docs long, parts array<string>, part_bits array<binary>, fail_bits array<binary>, good_bits binary, toxic_bits binary"


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _pack(batches):
    for batch in batches:
        part = batch.column(0).to_pylist()
        flags = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, batch.num_columns)]
        names = sorted(set(part))
        at = {p: k for k, p in enumerate(names)}
        own = np.array([at[p] for p in part], np.int64)
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(len(names) + 1))
        bits = []
        for k in range(len(names)):
            mask = np.zeros(len(part), bool)
            mask[order[ends[k] : ends[k + 1]]] = True
            bits.append(_bits(mask))
        row = {"docs": [len(part)], "parts": [names], "part_bits": [bits], "fail_bits": [[_bits(f) for f in flags[: len(FILTERS)]]], "good_bits": [_bits(flags[-2])], "toxic_bits": [_bits(flags[-1])]}
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))


def bitmap_index(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Bitmaps of blocks of documents, one row a block (an Arrow batch): a bit a document for each part, filter and label.

    ``docs, parts, part_bits, fail_bits, good_bits, toxic_bits``; ``part_bits`` has a bitmap for each of the block's
    parts, ``fail_bits`` one for each filter. Some bytes a document, so the index may be written and asked again.
    """
    ship_package(docs.sparkSession)
    rows = materialise(failures(docs, id_col, text_col, part_col), "filter-failures")
    flags = with_labels(with_copies(rows), labels, id_col)
    return flags.select("part", *"abcde", "good", "toxic").mapInArrow(_pack, INDEX)


def _ones(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def _count(batches):
    """Sums of a task: for each part, subset of filters that came before and filter, how many documents it removes then."""
    held: dict[str, np.ndarray] = {}

    def flush():
        names = list(held)
        n = len(names) * SUBSETS * len(FILTERS)
        table = np.stack([held[p] for p in names]).reshape(n, 5)
        grid = np.indices((len(names), SUBSETS, len(FILTERS))).reshape(3, n)
        apart = ((grid[1] >> grid[2]) & 1) == 0  # a filter that came before removes nothing again
        keep = np.flatnonzero(apart)
        cols = [pa.array([names[k] for k in grid[0][keep].tolist()], pa.string()), *[pa.array(grid[k][keep], pa.int32()) for k in (1, 2)], *[pa.array(table[keep, k]) for k in range(5)]]
        held.clear()
        return pa.RecordBatch.from_arrays(cols, names=["part", "before", "filter", "survivors", "removed", "failing", "good_lost", "toxic_lost"])

    for batch in batches:
        for parts, part_bits, fail_bits, good, toxic in zip(*[batch.column(k).to_pylist() for k in range(1, 6)], strict=True):
            fails = [np.frombuffer(b, np.uint8) for b in fail_bits]
            good, toxic = np.frombuffer(good, np.uint8), np.frombuffer(toxic, np.uint8)
            either = [np.zeros(len(good), np.uint8)]  # by subset: documents that one of its filters fails
            for s in range(1, SUBSETS):
                low = (s & -s).bit_length() - 1
                either.append(either[s & (s - 1)] | fails[low])
            for part, bits in zip(parts, part_bits, strict=True):
                own = np.frombuffer(bits, np.uint8)
                sums = held.setdefault(part, np.zeros((SUBSETS, len(FILTERS), 5), np.int64))
                failing = [_ones(own & f) for f in fails]
                for s in range(SUBSETS):
                    left = own & ~either[s]
                    survivors = _ones(left)
                    for k in range(len(FILTERS)):
                        if s >> k & 1:
                            continue
                        gone = left & fails[k]
                        sums[s, k] += (survivors, _ones(gone), failing[k], _ones(gone & good), _ones(gone & toxic))
                if len(held) >= FLUSH:
                    yield flush()
    if held:
        yield flush()


def interaction_counts(index: DataFrame) -> DataFrame:
    """``part, before, filter, survivors, removed, failing, good_lost, toxic_lost``: for each filter and each subset of the others (a bit mask) that came before it.

    AND-NOT and population counts in each task, then one sum over tasks.
    """
    sums = "survivors long, removed long, failing long, good_lost long, toxic_lost long"
    parts = index.mapInArrow(_count, f"part string, before int, filter int, {sums}")
    return parts.groupBy("part", "before", "filter").agg(*[F.sum(c.split()[0]).alias(c.split()[0]) for c in sums.split(", ")])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A: under 100 words; B: distinct words under 80 % of words; C: over 10 % capitals A-Z; D: holds any of ``#$%&*|``;
    E: the text of a row with a smaller id. Null texts are empty, null parts the empty string. A row without id is in
    no label and no copy of another; rows that repeat an id and its text are one text's first row each. An id with
    several labels counts if one of them does. An empty table gives no rows. Other columns are not looked at.

    What a filter removes depends only on which filters came before it, so the 600 rows of a part come from 80 counts;
    the orders are a table of 600 rows and are broadcast.
    """
    spark = docs.sparkSession
    counts = interaction_counts(bitmap_index(docs, labels, id_col, text_col, part_col))
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(FILTERS[j] for j in order), step, before, k))
            before |= 1 << k
    table = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, before int, filter int"))
    share = _orders_with(counts["before"])
    own = counts.groupBy("part", "filter").agg(F.sum(F.col("removed") * share).alias("shapley"), F.max(F.when(F.bit_count("before") == len(FILTERS) - 1, F.col("removed"))).alias("unique_fails"))
    held = counts.join(own, ["part", "filter"])
    return held.join(table, ["before", "filter"]).select(
        "part", "filter_order", "step", (F.col("survivors") - F.col("removed")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def _orders_with(before):
    """Orders in which exactly the filters of ``before`` come before a given one."""
    n = len(FILTERS)
    return F.factorial(F.bit_count(before)) * F.factorial(F.lit(n - 1) - F.bit_count(before))


def filter_audit_sql() -> str:
    """The same audit in DuckDB SQL: counts of each pattern of failures and labels, then every order."""
    letters = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l)"
    joined = " || ".join(f"x{k}.l" for k in range(5))
    apart = " AND ".join(f"x{i}.l <> x{j}.l" for i in range(5) for j in range(i))
    first = "substr(filter_order, 1, step - 1)"
    own = "substr(filter_order, step, 1)"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN w.doc_id > first THEN 'E' ELSE '' END) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
p AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT {joined} AS filter_order FROM {", ".join(f"{letters} x{k}" for k in range(5))} WHERE {apart}),
s AS (SELECT filter_order, step::INT AS step, {first} AS before, {own} AS letter FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS bad, fails = letter AS alone, length(translate(fails, before, '')) < length(fails) AS gone FROM p, s),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND bad), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (NOT gone AND bad AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND bad AND toxic), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
