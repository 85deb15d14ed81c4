"""The source divergence audit against a brute-force run in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataspark.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["term", "n", "docs", "block", "seat", "item", "part", "value", "rank", "terms", "total"]


def _brute(rows, top=200):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(SMALL))
        groups.add((lang, source))
        counts[lang, source].update(found)
        held[lang].update(set(found))
    kept = {lang: sorted(t for t, n in c.items() if n >= 3) for lang, c in held.items()}

    def shares(c, words):
        n = sum(c[t] for t in words)
        return {t: 1 + 10**9 * (c[t] + 1) // (n + len(words)) for t in words}

    out = set()
    for lang, source in groups:
        words = kept.get(lang, [])
        p = shares(counts[lang, source], words)
        whole = sum((counts[g] for g in groups if g[0] == lang), Counter())
        pairs = []
        for other in (s for x, s in groups if x == lang and s != source):
            q = shares(counts[lang, other], words)
            pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in words), other.encode(), other))
        q = shares(whole, words)
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in words if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    return out


def _rows(seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Aa", "bé", "ç", "Zz", "ß中") for b in ("x", "Y", "ü", "q")]
    rows = []
    for lang, sources in (("en", ["a", "b", "c", "d", "é", ""]), ("fr", ["a", None, "zz"]), ("one", ["only"])):
        for k in range(30):
            some = words[: rng.choice([3, 20])]
            rows.append((lang, rng.choice(sources), "".join(rng.choice(some) + rng.choice([" ", "1", "_", "\x7f", "@[", "\n"]) for _ in range(rng.randrange(30)))))
    rows += [rows[0]] * 12  # repeated rows
    rows += [("en", "empty", ""), ("en", "null", None), (None, None, None), (None, "x", "only once"), ("de", "u", "x y z"), ("de", "v", "x y")]  # de keeps no term
    return rows


def _docs(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "lang string, source string, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(ODD)])


def _got(docs, **kw):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in D.source_divergence(docs, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("blocks", "seats", "top"), [(1, 2, 200), (3, 4, 5)])
def test_equals_brute_force(spark, monkeypatch, blocks, seats, top):
    monkeypatch.setattr(D, "LEAST_BLOCKS", blocks)
    rows = _rows()
    assert _got(_docs(spark, rows).repartition(3), seats=seats, top=top) == _brute(rows, top)


def test_empty_table(spark, monkeypatch):
    monkeypatch.setattr(D, "LEAST_BLOCKS", 1)
    assert _got(_docs(spark, _rows()).limit(0), seats=2) == set()


def test_each_two_seats_meet_once():
    for seats in (2, 4, 6, 12):
        turns = D.rounds(seats)
        assert len(turns) == seats - 1
        assert all(sorted(s for m in t for s in m) == list(range(seats)) for t in turns)
        assert len({frozenset(m) for t in turns for m in t}) == seats * (seats - 1) // 2


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(D, "STRETCH", 7)
    text = "Aéb cde; fghijklmnopqrstuvwxyz-ééééééééé1 b" * 3 + "x" * 40
    got = [t.decode() for some in D.terms(text.encode()) for t in some]
    assert got == TERM.findall(text.translate(SMALL))
    assert list(D.terms(b"")) == []


def test_shares_are_exact_beyond_64_bits():
    rng = random.Random(1)
    for _ in range(200):
        whole = rng.randrange(1, 8 * 10**15)
        c = rng.randrange(0, whole)
        assert int(D.shares(np.array([c]), whole)[0]) == 1 + 10**9 * (c + 1) // whole


def test_vectors_come_back_from_their_bytes():
    for top in (1, 255, 256, 70_000, 2**40):
        v = np.array([0, 1, top], np.int64)
        assert (D.unsqueeze(D.squeeze(v)) == v).all()
    assert len(D.unsqueeze(D.squeeze(np.zeros(0, np.int64)))) == 0
