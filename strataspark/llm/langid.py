"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .sample import least_hashes

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 8_000
SMOOTHING = 0.5
NO_LANGUAGE = "und"
_MIX = {1: 0x9E3779B1, 2: 0x85EBCA6B, 3: 0xC2B2AE35, 4: 0x27D4EB2F, 5: 0x165667B1}
STRETCH = 1 << 18


def _lower(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def hashes(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of each n-gram of the texts that ``points`` is joined from; ``ends`` are their ends, and no n-gram crosses one."""
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    rows, buckets = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = len(points) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h = (h ^ points[k : k + m]) * np.uint32(_MIX[n])
                h ^= h >> np.uint32(15)
            inside = row[:m] == row[n - 1 :]
            rows.append(row[:m][inside])
            buckets.append(h[inside] & np.uint32(BUCKETS - 1))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(rows), np.concatenate(buckets)


def _stretches(text: str):
    """Parts of a text that hold each of its n-grams once."""
    points = _lower(text)
    if len(points) <= STRETCH:
        yield points, None
        return
    reach = max(ORDERS) - 1
    for k in range(0, len(points), STRETCH):
        tail = points[k + STRETCH : k + STRETCH + reach]
        yield points[k : k + STRETCH + reach], tail if len(tail) else None


def _batches(texts):
    """``(rows, points, ends, twice)`` of many stretches at once; n-grams of ``twice`` (the overlap of two stretches) count once too often."""
    rows, parts, size = [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        for points, tail in _stretches(text):
            rows.append((k, 1))
            parts.append(points)
            if tail is not None:
                rows.append((k, -1))
                parts.append(tail)
            size += len(points)
            if size >= STRETCH:
                yield np.array(rows), np.concatenate(parts), np.cumsum([len(p) for p in parts])
                rows, parts, size = [], [], 0
    if parts:
        yield np.array(rows), np.concatenate(parts), np.cumsum([len(p) for p in parts])


@dataclass
class Model:
    """``languages`` and, for each bucket (row), the log probability in each language (column).

    ``prior`` is the log share of each language among the learned documents, ``usual`` the log probability that an
    n-gram of it has on average, and ``chance`` that of an n-gram of any other letters.
    """

    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray
    usual: np.ndarray
    chance: np.ndarray

    def score_all(self, texts: list) -> list[tuple[str, float, float]]:
        """Best language, its posterior probability and the evidence for it, of each text.

        The counts of n-grams of a batch are a sparse matrix (texts x buckets) and its product with the log
        matrix gives all sums at once. The posterior is that of all n-grams of the text. ``evidence`` is
        1 where n-grams are as likely as in the learned documents of the language and 0 where they are as those
        of other letters; unlike the posterior it does not saturate.
        ``und``, 0.0 and 0.0 for a text without a letter, or if nothing was learned.
        """
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        if self.languages:
            for rows, points, ends in _batches(texts):
                part, bucket = hashes(points, ends)
                order = np.argsort(part, kind="stable")
                part, bucket = part[order], bucket[order]
                if not len(part):
                    continue
                first = np.flatnonzero(np.diff(part, prepend=-1))
                sums = np.add.reduceat(self.log_prob[bucket], first, axis=0)
                own, sign = rows[part[first]].T
                np.add.at(total, own, sums * sign[:, None])
                np.add.at(n, own, np.diff(first, append=len(part)) * sign)
        mean = total / np.maximum(n, 1)[:, None]
        z = total + self.prior
        out = []
        for k, text in enumerate(texts):
            if not text or not self.languages or not any(map(str.isalpha, text)):
                out.append((NO_LANGUAGE, 0.0, 0.0))
                continue
            best = int(np.argmax(z[k]))
            evidence = (mean[k, best] - self.chance[best]) / (self.usual[best] - self.chance[best])
            out.append((self.languages[best], float(1 / np.exp(z[k] - z[k, best]).sum()), float(min(1.0, max(0.0, evidence)))))
        return out


def _count(batches):
    """Sparse counts of a task's labelled texts, one row for each language: bounded by languages x buckets. Entry ``BUCKETS`` counts texts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lang in langs:
            counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[BUCKETS] += 1
        for rows, points, ends in _batches(batch.column(0).to_pylist()):
            part, bucket = hashes(points, ends)
            for own in {langs[k] for k in rows[:, 0].tolist()}:
                mine = np.array([s if langs[k] == own else 0 for k, s in rows.tolist()])
                found = np.bincount(bucket, weights=mine[part], minlength=BUCKETS)
                counts[own][:BUCKETS] += found.astype(np.int64)
    rows = sorted(counts)
    lists = [np.flatnonzero(counts[k]) for k in rows]
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    pack = lambda parts, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(kind)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.string()), pack(lists, np.int32), pack([counts[k][at] for k, at in zip(rows, lists, strict=True)], np.int64)],
        names=["lang", "buckets", "counts"],
    )


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` rows with a label (those with the least hash of their id).

    The bound keeps the training set, and with it the languages and counts that come to
    the driver, of a fixed size. The texts of the sample are read whole.
    """
    ship_package(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = least_hashes(rows, key_col, sample_rows)
    parts = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(_count, "lang string, buckets array<int>, counts array<long>")
    sums = parts.select("lang", F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("lang", F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))
    held = sums.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")).collect()
    return model_of({r["lang"]: (r["buckets"], r["counts"]) for r in held})


def model_of(held: dict[str, tuple[list[int], list[int]]]) -> Model:
    """The model of each language's buckets and counts; the count of bucket ``BUCKETS`` is that of its texts."""
    languages = sorted(held)
    counts = np.zeros((BUCKETS + 1, len(languages)))
    for k, lang in enumerate(languages):
        counts[held[lang][0], k] = held[lang][1]
    docs, counts = counts[BUCKETS], counts[:BUCKETS]
    if not languages:
        return Model(languages, counts, docs, docs, docs)
    log_prob = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS))
    usual = (counts * log_prob).sum(0) / np.maximum(counts.sum(0), 1)
    return Model(languages, log_prob, np.log(docs / docs.sum()), usual, log_prob.mean(0))


def _predict(model):
    def run(batches):
        m = model.value
        for batch in batches:
            found = m.score_all(batch.column(0).to_pylist())
            rest = [batch.column(k) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array([f[0] for f in found], pa.string()), *[pa.array([f[k] for f in found], pa.float64()) for k in (1, 2)]],
                names=[*batch.schema.names[1:], "lang_pred", "score", "evidence"],
            )

    return run


def predict(docs: DataFrame, model: Model, keep: dict, text_col: str = "text") -> DataFrame:
    """``keep`` (names to columns, with their types) and ``lang_pred``, ``score``, ``evidence`` of each row; the matrix is broadcast (buckets x languages).

    ``keep`` gives the columns names of its own, so that a table that has columns of the answer's names can be asked again.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(text_col).alias("__text"), *[c.alias(k) for k, c in keep.items()])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), f"{ddl}, lang_pred string, score double, evidence double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, evidence`` of every row, from its text alone.

    Learns from rows with a label whose ``crc32(id) mod 5`` is not 0. A null text and one without a letter are
    ``und`` with score and evidence 0; a null id is not held out and not learned from. With no labelled row all is ``und``.
    Repeated rows are answered each. Whole texts are scored, long ones in stretches.
    """
    out = F.coalesce(held_out(id_col), F.lit(False))
    model = fit(docs.filter(~held_out(id_col)), text_col, lang_col, id_col)
    return predict(docs, model, {"doc_id": F.col(id_col).cast("long"), "held_out": out}, text_col)
