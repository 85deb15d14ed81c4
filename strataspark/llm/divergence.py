"""Source divergence audit: how the vocabularies of a language's sources differ, by a rotation of compressed vectors."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, release, ship_package

SCALE_STEPS = (1000, 1000, 1000)  # a share is counted in parts of 10 ** 9, which long division finds in three steps
LEAST_DOCS = 3
TOP_TERMS = 200
SEATS = 6  # tiles of a language's sources that meet in turn; even, so that nobody sits out
LEAST_BLOCKS = 32  # parts of a vocabulary
BLOCK_ROWS = 400_000  # counted rows that a part of the vocabularies has on average at most
HELD_TERMS = 400_000  # terms whose counts a task holds before it hands them on
STRETCH = 1 << 20  # bytes of a text that are split at once

_PLAIN = bytes((c | 32 if chr(c).isalpha() else 32) if c < 128 else c for c in range(256))


def terms(raw: bytes):
    """Lists of the terms of a text in UTF-8: runs of ASCII letters, made small, and of all letters and marks beyond ASCII."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + STRETCH)
        plain = raw[at:end].translate(_PLAIN)
        if end < len(raw) and plain[-1:] != b" ":  # give the last term back, or go on to its end
            cut = plain.rfind(b" ")
            if cut <= 0:
                while end < len(raw) and _PLAIN[raw[end]] != 32:
                    end += 1
                plain = raw[at:end].translate(_PLAIN)
            else:
                end, plain = at + cut, plain[:cut]
        yield plain.split()
        at = end


def _count(batches):
    """Counts of a task's terms by language and source, with the documents that hold each; a group is also told by a row without term."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush():
        names, parts = [], [[], [], []]
        for key, (n, docs) in held.items():
            names += [key] * len(n)
            parts[0] += n.keys()
            parts[1] += n.values()
            parts[2] += [docs[t] for t in n]
        held.clear()
        return out(names, *parts)

    def out(names, words, counts, docs):
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in names], pa.string()), pa.array([k[1] for k in names], pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )

    groups, size = set(), 0
    for batch in batches:
        for raw, lang, source in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            key = (lang, source)
            groups.add(key)
            if len(groups) >= HELD_TERMS:
                yield out(list(groups), [None] * len(groups), [0] * len(groups), [0] * len(groups))
                groups.clear()
            own: Counter = Counter()
            for some in terms(raw):
                own.update(some)
            n, docs = held.setdefault(key, (Counter(), Counter()))
            size -= len(n)
            n.update(own)
            docs.update(own.keys())
            size += len(n)
            if size >= HELD_TERMS:
                yield flush()
                size = 0
    if held:
        yield flush()
    if groups:
        yield out(list(groups), [None] * len(groups), [0] * len(groups), [0] * len(groups))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Partial counts ``lang, source, term, n, docs`` (``term`` in UTF-8), combined in each task; null stands for empty. A group without terms has its row without term too."""
    ship_package(docs.sparkSession)
    blank = F.lit("")
    rows = docs.select(F.coalesce(F.col(text_col), blank).cast("binary").alias("t"), F.coalesce(F.col(lang_col), blank).alias("l"), F.coalesce(F.col(source_col), blank).alias("s"))
    return rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")


def squeeze(numbers: np.ndarray) -> bytes:
    """Whole numbers of 0 and more as bytes: the least width that holds them, deflated."""
    width = next(w for w in (1, 2, 4, 8) if int(numbers.max(initial=0)) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + zlib.compress(numbers.astype(f"<u{width}").tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


SEGMENT = "lang string, block int, source string, terms long, total long, places binary, counts binary, words binary"


def _pack(least_docs):
    def run(key, table):
        """A block of one language's vocabulary: kept terms in order, and the sparse vector of each source over them; the row without source holds the language's own."""
        lang, block = key[0].as_py(), key[1].as_py()
        term, place = np.unique(np.array(table.column("term").to_pylist(), object), return_inverse=True)
        n, docs = table.column("n").to_numpy(), table.column("docs").to_numpy()
        held = np.zeros(len(term), np.int64)
        np.add.at(held, place, docs)
        keep = held >= least_docs
        new = np.cumsum(keep) - 1
        on = keep[place]
        place, n = new[place[on]], n[on]
        own = np.zeros(int(keep.sum()), np.int64)
        np.add.at(own, place, n)
        rows = []
        if len(own):
            source = np.array(table.column("source").to_pylist(), object)[on]
            order = np.lexsort((place, source))
            source, place, n = source[order], place[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
            for a, b in zip(first, [*first[1:], len(source)], strict=True):
                rows.append((source[a], int(n[a:b].sum()), squeeze(np.diff(place[a:b], prepend=0)), squeeze(n[a:b]), None))
            rows.append((None, int(own.sum()), squeeze(np.concatenate([[0], np.ones(len(own) - 1, np.int64)])), squeeze(own), zlib.compress(b" ".join(term[keep]), 1)))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        size = len(rows)
        return pa.table(
            [pa.array([lang] * size, pa.string()), pa.array([block] * size, pa.int32()), pa.array(cols[0], pa.string()), pa.array([len(own)] * size, pa.int64()), pa.array(cols[1], pa.int64())]
            + [pa.array(c, pa.binary()) for c in cols[2:]],
            names=["lang", "block", "source", "terms", "total", "places", "counts", "words"],
        )

    return run


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """``1 + floor(10 ** 9 * (count + 1) / whole)``, exactly, for counts under ``whole`` and ``whole`` up to 9 * 10 ** 15."""
    quotient, rest = np.divmod(counts + 1, whole)
    for step in SCALE_STEPS:
        up, rest = np.divmod(rest * step, whole)
        quotient = quotient * step + up
    return quotient + 1


class Vector:
    """A sparse vector of shares over a block: those of its terms, and the one share of all terms that it lacks."""

    def __init__(self, row: dict):
        self.source = row["source"]
        whole = row["group_total"] + row["kept"]
        have = row["places"] is not None
        self.place = np.cumsum(unsqueeze(row["places"])) if have else np.zeros(0, np.int64)
        self.share = shares(unsqueeze(row["counts"]), whole) if have else np.zeros(0, np.int64)
        self.rest = int(shares(np.zeros(1, np.int64), whole)[0]) if whole else 1
        self.terms = row["block_terms"]

    def dense(self) -> np.ndarray:
        out = np.full(self.terms, self.rest, np.int64)
        out[self.place] = self.share
        return out


def meet(a: Vector, dense: np.ndarray, b: Vector) -> tuple[int, int]:
    """Sums over the block of ``floor((p - q) ** 2 / q)``, with ``p`` of ``a`` and ``q`` of ``b``, and the other way round; ``dense`` is ``a`` in full."""
    p, q = dense[b.place], b.share
    gap = (p - q) ** 2
    to, back = int((gap // q).sum()), int((gap // p).sum())
    only = a.place if not len(b.place) else a.place[~_within(a.place, b.place)]
    p = dense[only]
    gap = (p - b.rest) ** 2
    to, back = to + int((gap // b.rest).sum()), back + int((gap // p).sum())
    neither = a.terms - len(b.place) - len(only)
    gap = (a.rest - b.rest) ** 2
    return to + neither * (gap // b.rest), back + neither * (gap // a.rest)


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` are in ``b``; both in order."""
    at = np.searchsorted(b, a)
    return b[np.minimum(at, len(b) - 1)] == a


PAIRS = "lang string, part string, source string, item string, value long"


def _rows(lang, part, rows):
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    n = len(rows)
    return pa.table([pa.array([lang] * n, pa.string()), pa.array([part] * n, pa.string()), *[pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)]], names=["lang", "part", "source", "item", "value"])


def _tournament(key, resident, visitor):
    """One meeting: each source of the resident seat with each of the visiting one, in both directions."""
    guests = [Vector(r) for r in visitor.to_pylist()]
    rows = []
    for r in resident.to_pylist() if guests else ():
        a = Vector(r)
        dense = a.dense()
        for b in guests:
            to, back = meet(a, dense, b)
            rows += [(a.source, b.source, to), (b.source, a.source, back)]
    return _rows(key[0].as_py(), "pair", rows)


def _at_home(top):
    """The first round: the sources of a seat meet each other, and each meets its language's own vector, whose best terms it keeps in a heap."""

    def run(key, resident, visitor):
        lang, own = key[0].as_py(), [Vector(r) for r in resident.to_pylist()]
        pairs = []
        for k, a in enumerate(own):
            dense = a.dense()
            for b in own[:k]:
                to, back = meet(a, dense, b)
                pairs += [(a.source, b.source, to), (b.source, a.source, back)]
        found = []
        for r in visitor.to_pylist():
            language, words = Vector(r), zlib.decompress(r["words"]).split(b" ")
            whole = language.dense()
            for a in own:
                q = whole[a.place]
                up = np.flatnonzero(a.share > q)
                if not len(up):
                    continue
                value = (a.share[up] - q[up]) ** 2 // q[up]
                floor = np.partition(value, -top)[-top] if len(value) > top else 0
                on = np.flatnonzero(value >= floor)
                best = heapq.nsmallest(top, zip((-value[on]).tolist(), a.place[up][on].tolist(), strict=True))  # places are in the order of the terms
                found += [(a.source, words[k].decode("utf-8", "replace"), -v) for v, k in best]
        return pa.concat_tables([_rows(lang, "pair", pairs), _rows(lang, "term", found)])

    return run


def rounds(seats: int) -> list[list[tuple[int, int]]]:
    """Round-robin tournament: ``seats - 1`` rounds in which each seat meets another, by turning all but the last around."""
    turn = seats - 1
    return [[(k, turn)] + [((k + j) % turn, (k - j) % turn) for j in range(1, seats // 2)] for k in range(turn)]


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", seats: int = SEATS, top: int = TOP_TERMS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language differs from its other sources and from the language.

    Terms are runs of letters A-Z, a-z (made small) and of everything beyond ASCII, of whole texts. A language keeps the terms
    that ``least_docs`` of its documents hold. A share is ``1 + floor(10 ** 9 * (count + 1) / (all counts + kept terms))``, and what
    two shares differ by is ``floor((p - q) ** 2 / q)``, in whole numbers throughout.
    Part ``pair`` sums it over all kept terms, for each other source. Part ``term`` gives it for the ``top`` terms
    that the source uses more than its language, and holds no term that it lacks.

    Null texts, languages and sources are empty strings; an empty language or source is one like any other. Repeated rows count
    each time. A language that keeps no term has its pairs with value 0; one with a single source has none. An empty table gives no rows.
    Other columns are not looked at.

    Terms are counted in each task, then by language, part of the vocabulary, source and term. The parts are about as many as
    keep ``BLOCK_ROWS`` rows in each, so no task holds a whole vocabulary. Sources are dealt to ``seats`` tiles, which
    stay where they are, and in ``seats - 1`` rounds a compressed copy of each travels to the seat that it meets. Sums over parts
    come last. The number of rounds does not grow with the data; a seat's sources do.
    """
    counted = materialise(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    groups = counted.filter("term is null").groupBy("lang", "source").agg(F.lit(0).alias("one")).drop("one")
    words = counted.filter("term is not null")
    blocks = max(LEAST_BLOCKS, -(-words.count() // BLOCK_ROWS))
    dealt = words.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")).repartition("lang", "block")
    summed = dealt.groupBy("lang", "block", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    segments = materialise(summed.groupBy("lang", "block").applyInArrow(_pack(least_docs), SEGMENT), "term-vectors")
    whole = segments.filter("source is null")
    kept = whole.groupBy("lang").agg(F.sum("terms").alias("kept"), F.sum("total").alias("lang_total"))
    totals = segments.filter("source is not null").groupBy("lang", "source").agg(F.sum("total").alias("group_total"))
    zero = F.lit(0).cast("long")
    group = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", F.coalesce("group_total", zero).alias("group_total"), F.coalesce("kept", zero).alias("kept"))
    # every source sits in every block of its language, with or without terms there
    grid = group.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("seat", F.pmod(F.xxhash64("source"), F.lit(seats)).cast("int"))
    sizes = whole.select("lang", "block", F.col("terms").alias("block_terms"))
    vectors = segments.filter("source is not null").select("lang", "block", "source", "places", "counts")
    present = grid.join(sizes, ["lang", "block"], "left").withColumn("block_terms", F.coalesce("block_terms", zero)).filter("block_terms > 0 or block = 0")
    columns = ["lang", "block", "seat", "source", "group_total", "kept", "block_terms", "places", "counts"]
    seated = materialise(present.join(vectors, ["lang", "block", "source"], "left").select(*columns), "seated-vectors")
    resident = seated.repartition("lang", "block", "seat").persist()
    keys = ["lang", "block", "seat"]

    def visit(rows: DataFrame, meeting) -> DataFrame:
        return resident.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meeting, PAIRS)

    language = whole.join(kept, "lang").select(
        "lang", "block", F.explode(F.sequence(F.lit(0), F.lit(seats - 1))).alias("seat"), "source", F.col("lang_total").alias("group_total"), "kept", F.col("terms").alias("block_terms"), "places", "counts", "words"
    )
    met = [materialise(visit(language, _at_home(top)), "met-at-home")]
    for k, meetings in enumerate(rounds(seats)):
        host = reduce(lambda c, m: c.when(F.col("seat") == m[1], m[0]), meetings, F.when(F.lit(False), 0))
        guests = seated.withColumn("host", host).filter("host is not null").drop("seat").withColumnRenamed("host", "seat")
        met.append(materialise(_summed(visit(guests, _tournament)), f"met-{k}"))
    resident.unpersist()
    release(segments, seated, counted)
    found = reduce(DataFrame.unionByName, met)
    pairs = _summed(found.filter("part = 'pair'"))
    order = Window.partitionBy("lang", "part", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    best = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence_sql() -> str:
    """The same audit in DuckDB SQL."""
    share = lambda c, n, v: f"(1 + (1000000000::HUGEINT * ({c} + 1)) // ({n} + {v}))::BIGINT"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, {share("coalesce(c.n, 0)", "coalesce(s.n, 0)", "v.v")} AS p, {share("k.n", "v.n", "v.v")} AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM every_pair UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q))
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
