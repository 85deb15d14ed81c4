import random

import numpy as np

from strataspark.llm import simhash


def _chain(rng, n, words=200, changed=5):
    """Texts of which each has a few words of the one before it changed."""
    now = [f"w{rng.randrange(3000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(now))
        now = list(now)
        for _ in range(changed):
            now[rng.randrange(words)] = f"w{rng.randrange(3000)}"
    return out


def _links(prints, most):
    """Pairs within ``most`` bits that share a key of some table."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    samples = simhash._samples()
    return [(a, b) for a in range(len(bits)) for b in range(a) if (d := bits[a] != bits[b]).sum() <= most and not d[samples].any(1).all()]


def _roots(n, links):
    root = list(range(n))
    for a, b in links:
        a, b = root[a], root[b]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_members_of_a_hot_key_all_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 2)  # each key that two prints share
    monkeypatch.setattr(simhash, "COUNTED", 1)
    monkeypatch.setattr(simhash, "_confirmed", lambda asked, *rest: asked.select("u", "v"))  # candidates only
    rng = random.Random(3)
    texts = [t for _ in range(2) for t in _chain(rng, 60, changed=9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r[0]: r[1:] for r in simhash.fingerprints(df, 5, simhash.LANES, distinct=True).select("doc_id", *simhash._LANES).collect()}
    want = _roots(len(texts), _links(np.array([prints[k] for k in range(len(texts))], "<i8"), simhash.bits_for(0.8)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_texts_under_the_similarity_do_not_link(spark):
    rng = random.Random(6)
    texts = []
    for k in range(150):  # pairs of about 0.84, 0.7 and 0.6
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(20), (3, 7, 10)[k % 3]):
            other[at * 10] = f"w{rng.randrange(5000)}"
        texts += [" ".join(base), " ".join(other)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    near = [len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) >= 0.8 for k in range(0, 300, 2)]
    linked = [got[k] == got[k + 1] for k in range(0, 300, 2)]
    assert sum(near) == 50
    assert not any(x and not n for x, n in zip(linked, near, strict=True))
    assert sum(x and n for x, n in zip(linked, near, strict=True)) >= 46


def test_clashing_and_missing_ids(spark):
    rng = random.Random(2)
    a, b, c = ([f"{x}{rng.randrange(3000)}" for _ in range(120)] for x in "abc")
    near = lambda words: " ".join([*words[:60], "other", *words[61:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(b)), (None, near(a)), (None, " ".join(c)), (None, near(c)), (9, None), (9, ""), (8, " "), (5, " ".join(a))]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node int")
    got = {(r["doc_id"], r["t"]): (r["component_id"], r["first"]) for r in simhash.near_groups(df).collect()}
    assert sorted(got.values(), key=str) == sorted([(5, True), (5, True), (5, False), (5, False), (None, True), (None, False), (9, True), (9, True), (8, True)], key=str)
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_first_of_near(df).collect()]
    assert sorted(k for k in kept if k[0] is not None and (k[1] or "").strip()) == sorted([rows[0], rows[1]])
    assert sum(k[0] is None for k in kept) == 1 and len(kept) == 6
