"""The filter audit against a brute-force run of every order."""

import random
import re
from itertools import permutations

from strataspark.llm import filter_audit as A

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["fp", "digest", "words", "part", "first_id", "first_digest", "label_id", "good", "toxic", "e", "t", "filter", "before"]


def _brute(rows, labels):
    """Rows ``(doc_id, text, lang)``; every order is applied one document at a time."""
    facts, parts = [], {}
    for k, (doc_id, text, lang) in enumerate(rows):
        t = text or ""
        words = BLANK.findall(t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in rows),
        }
        own = [r for r in labels if r[0] == doc_id and doc_id is not None]
        facts.append((fails, any(r[1] == 1 for r in own), any(r[2] == 1 for r in own)))
        parts.setdefault(lang or "", []).append(k)
    out = {}
    for part, members in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(members)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if facts[k][0][f]]
                redundant = sum(facts[k][0][f] for k in members) - len(gone)
                left = [k for k in left if k not in set(gone)]
                alone = sum(facts[k][0][f] and sum(facts[k][0].values()) == 1 for k in members)
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(facts[k][1] for k in gone), sum(facts[k][2] for k in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def _got(docs, labels):
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in cols] for r in A.filter_audit(docs, labels).collect()}


def _rows(n):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["UPPER", "Ünï", "a#b", "x\x1fy", "c d"]
    rows = []
    for k in range(n):
        size = rng.choice([0, 1, 40, 99, 100, 101, 140])
        few = rng.choice([60, 300, 305])
        text = rng.choice([" ", "\n", "\x0b "]).join(rng.choice(words[:few]) for _ in range(size))
        rows.append((k, text.upper() if rng.random() < 0.1 else text, rng.choice(["en", "fr", None])))
    rows += [(n + k, rows[k % 7][1], "fr") for k in range(60)]  # many copies
    rows += [(3, rows[3][1], "en"), (4, "another text of a repeated id", "en"), (None, rows[0][1], "en"), (None, None, None), (n + 99, None, "en"), (n + 98, "", "en"), (n + 97, "word " * 30_000, "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, n, 2)] + [(2, 1, 1), (2, 0, 0), (10**9, 1, 1), (None, 1, 1)]
    return rows, labels


def _tables(spark, rows, labels):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(ODD)])
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_every_order_equals_brute_force(spark):
    rows, labels = _rows(120)
    docs, held = _tables(spark, rows, labels)
    assert _got(docs, held) == _brute(rows, labels)


def test_result_does_not_depend_on_partitions(spark):
    rows, labels = _rows(60)
    docs, held = _tables(spark, rows, labels)
    assert _got(docs.repartition(7), held) == _got(docs.coalesce(1), held) == _brute(rows, labels)


def test_empty_tables(spark):
    rows, labels = _rows(20)
    docs, held = _tables(spark, rows, labels)
    assert A.filter_audit(docs.limit(0), held).count() == 0
    got = _got(docs, held.limit(0))
    assert got == _brute(rows, []) and not any(v[4] or v[5] for v in got.values())


def test_index_holds_a_bit_for_each_row(spark):
    rows, labels = _rows(50)
    docs, held = _tables(spark, rows, labels)
    blocks = A.bitmap_index(docs, held).collect()
    assert sum(b["docs"] for b in blocks) == len(rows)
    for b in blocks:
        assert sum(int.from_bytes(p, "big").bit_count() for p in b["part_bits"]) == b["docs"] and len(b["fail_bits"]) == 5
