import random

import numpy as np
import pytest
import xxhash

from strataspark.llm import simhash


def _slow(text, words):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    if not w:
        return 0
    parts = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _texts(rng, groups, copies, words=120, edits=3):
    vocabulary = [f"word{k}" for k in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        out.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    return out


def _roots(n, links):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_fingerprints_and_components_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    texts = [*_texts(rng, 25, 8, 300, 1), "", "one", "one two", None, "", "one"]
    prints = [_slow(t, 3) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = {k: (f"{prints[k]:016x}", r) for k, r in enumerate(_roots(len(texts), links))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bucket in (64, 1):  # the pairs of small buckets, and the way of large ones
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(df).collect()}
        assert got == want


def test_links_of_prints_at_two_bits_are_all_found(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b for x in base for b in [x, *(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6))]}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {tuple(sorted((r["u"], r["v"]))) for r in simhash.fingerprint_links(df).collect()}
    p = sorted(map(signed, prints))
    want = {(a, b) for k, a in enumerate(p) for b in p[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_chain_test_never_drops_a_near_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, (500, 4)).astype(np.uint64)
    b = a.copy()
    for k in range(500):
        for bit in rng.integers(0, 256, rng.integers(0, 70)):
            b[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    for k in range(500):
        d = int(np.bitwise_count(a[k] ^ b[k]).sum())
        assert bool(simhash._near(a[k], b[k : k + 1], 47)[0]) == (d <= 47)


@pytest.mark.parametrize("hot", [50_000, 20])
def test_near_duplicates_are_caught_and_others_left(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(9)
    texts = _texts(rng, 60, 3, 300, 6)
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    near = [(a, b) for a in range(len(texts)) for b in range(a) if len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8]
    assert sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near) > 50
    assert all(got[k] // 4 == k // 4 for k in got)  # groups of four never meet
