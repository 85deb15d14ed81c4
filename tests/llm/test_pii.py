"""Personal data: base spans against the plain patterns, the field against all segmentations, and what it adds."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from strataspark.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain(text):
    """The patterns as they stand, with every check in words of its own."""
    found = []
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if name == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if name == "card":
                total = 0
                for k, d in enumerate(reversed(digits)):
                    d = 2 * d if k % 2 else d
                    total += d - 9 if d > 9 else d
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


@pytest.mark.parametrize("alphabet", ["ab@.-", "a@.%+9é ", "0129. ", "12.5-", "0 1-2345678", "+12()3 .-45", "+1 234567890.@a-\n"])
def test_base_spans_are_those_of_the_patterns(alphabet):
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert P.base_spans(text) == _plain(text), repr(text)


def test_base_spans_of_marked_texts():
    text = "x 4111 1111-1111 1111 +1 (555) 555-5657 a.b%c@d-e.f.gh. 1.2.3.4.5.6.7.8 001.02.3.255 256.1.1.1 4111111111111112 @a.b é@a"
    assert P.base_spans(text) == _plain(text) != []


def test_long_texts_take_time_in_proportion():
    began = time.perf_counter()
    for text in ("a" * 500_000, "9" * 500_000, "1 " * 100_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "a@b.c " * 20_000):
        base = P.base_spans(text)
        assert len(base) == (20_000 if text.startswith("a@b.c") else len(base))
    assert time.perf_counter() - began < 20


@pytest.fixture(scope="module")
def field():
    return P.train([("die Zahl 123456 und das Wort", []), ("mail a.b@c.de an", [(5, 0, 13)])], 500)


def _all_readings(lattice):
    n, edges = len(lattice.words), lattice.edges()

    def go(i, label):
        if i == n:
            yield []
            return
        for e in edges:
            if e[0] == i:
                for rest in go(e[1], e[2]):
                    yield [e, *rest]

    return go(0, 0)


def _score(field, reading):
    at, total = 0, 0.0
    for _, _, label, f in reading:
        total += field.turn[at, label] + field.weights[f].sum()
        at = label
    return total


def test_best_reading_is_the_best_of_all(field):
    rng = random.Random(2)
    noise = np.random.default_rng(3)
    for k in range(60):
        text = "".join(rng.choice(["12", "345", "6789", " ", "-", ".", "(", ")", "+1", "0"]) for _ in range(7))
        lattice = P.Lattice(text, 0, len(text), [(2, 4)] if k % 3 == 0 else [], True)
        shaken = P.Field()
        shaken.weights, shaken.turn = field.weights + noise.normal(0, 1, P.BUCKETS), field.turn + noise.normal(0, 1, field.turn.shape)
        readings = list(_all_readings(lattice))
        best = max(readings, key=lambda r: _score(shaken, r))
        want = [(lattice.cuts[i], label - 1, lattice.cuts[j]) for i, j, label, _ in best if label]
        assert [s for s in shaken.best(lattice) if s in want] == shaken.best(lattice)
        old, P.MARGIN = P.MARGIN, -math.inf
        try:
            assert shaken.best(lattice) == want
        finally:
            P.MARGIN = old


def test_slope_is_that_of_the_likelihood(field):
    text = "12 345-6789 0"
    lattice = P.Lattice(text, 0, len(text), [], True)
    edges, n = lattice.edges(), len(lattice.words)
    segment = next(e for e in edges if e[2])
    gold = {(segment[0], segment[1], segment[2] - 1)}
    value, slope, turns = field.slope(edges, n, gold)
    true = [_score(field, r) for r in _all_readings(lattice)]
    chosen = [r for r in _all_readings(lattice) if {(i, j, label - 1) for i, j, label, _ in r if label} == gold]
    assert len(chosen) == 1 and value == pytest.approx(_score(field, chosen[0]) - np.logaddexp.reduce(true))
    for f in list(slope)[:8]:
        moved = P.Field()
        moved.turn, moved.weights = field.turn, field.weights.copy()
        moved.weights[f] += 1e-5
        assert (moved.slope(edges, n, gold)[0] - value) / 1e-5 == pytest.approx(slope[f], abs=1e-3)
    moved = P.Field()
    moved.weights, moved.turn = field.weights, field.turn.copy()
    moved.turn[0, segment[2]] += 1e-5
    assert (moved.slope(edges, n, gold)[0] - value) / 1e-5 == pytest.approx(turns[0, segment[2]], abs=1e-3)


def test_held_out_snippets(field):
    found = right = wrong = clean = 0
    for text, spans in P._made(["house", "Water", "people", "mit", "und", "les"], random.Random(99), 600):
        base = P.base_spans(text)
        got = set(base) | set(P.added_spans(text, base, field))
        if spans:
            found, right = found + 1, right + (spans[0] in got)
        else:
            clean, wrong = clean + 1, wrong + bool(got - set(base))
    assert right / found > 0.85 and wrong / clean < 0.05


def test_added_spans_stand_apart(field):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["+1 555 123 4567", " ", "(555) 123-4567", "4111111111111111", "bob (at) example.com", "a@b.cd", "1.2.3.4", ", ", "x", "\n", "77"]) for _ in range(8))
        base = P.base_spans(text)
        more = P.added_spans(text, base, field)
        spans = sorted(more)
        assert all(a[2] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert not any(a < e and s < b for a, _, b in more for s, _, e in base)


def test_query_rows(spark, odd):
    ip_rows = [(100, "call (555) 123-4567 or mail bob (at) example.com, 10.0.0.1"), (101, "1.2.3.4 " * 5000), (102, "7" * 200_000)]
    docs = odd.select("doc_id", "text", "key", "n", "spans").unionByName(spark.createDataFrame(ip_rows, "doc_id long, text string"), allowMissingColumns=True)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = P.personal_data(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        base = _plain(text[r["doc_id"]]) if r["doc_id"] != 102 else []
        names = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(names.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in base) for k in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert len(spans) == len(base) + r["n_added"] and set(names.split(",")) - {""} <= set(spans)
    assert next(r for r in rows if r["doc_id"] == 100)["n_added"] >= 1


def test_result_does_not_depend_on_partitions(spark, odd):
    docs = odd.select("doc_id", "text")
    assert sorted(map(str, P.personal_data(docs.repartition(5)).collect())) == sorted(map(str, P.personal_data(docs.coalesce(1)).collect()))
