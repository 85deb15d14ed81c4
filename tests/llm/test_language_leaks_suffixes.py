import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from strataspark.llm import decontam, langid, suffix_dedup


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    out = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] == (r in out) for r in rows)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in out]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_does_not_learn_from_held_out_rows(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0]
    rows = [(k, "qqqq wwww" if k in held else "hello there friend", "xx" if k in held else "en") for k in range(200)]
    got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"en"}


def _bucket(gram):
    """One n-gram at a time, from the definition of the hash."""
    h = len(gram)
    for c in gram:
        h = (h ^ ord(c)) * langid._MIX[len(gram)] & 0xFFFFFFFF
        h ^= h >> 15
    return h & (langid.BUCKETS - 1)


def _grams(text):
    text = text.lower()
    return [_bucket(text[k : k + n]) for n in langid.ORDERS for k in range(len(text) - n + 1)]


def test_scores_against_brute_force(monkeypatch):
    rng = random.Random(5)
    letters = {"aa": "abcdé ", "bb": "defgà ", "cc": "xyz日 "}
    learned = [(k, "".join(rng.choice(letters[k]) for _ in range(rng.randint(0, 90)))) for k in letters for _ in range(40 if k == "aa" else 10)]
    monkeypatch.setattr(langid, "STRETCH", 37)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in learned]), pa.array([k for k, _ in learned])], names=["text", "lang"])
    model = langid.model_of({r["lang"]: (r["buckets"], r["counts"]) for r in next(langid._count([batch])).to_pylist()})
    counts = {k: Counter(g for lang, t in learned if lang == k for g in _grams(t)) for k in letters}
    sums = {k: sum(c.values()) for k, c in counts.items()}
    logs = lambda k, g: math.log((counts[k][g] + langid.SMOOTHING) / (sums[k] + langid.SMOOTHING * langid.BUCKETS))
    texts = ["".join(rng.choice("abcdefgxyzéà日 ") for _ in range(rng.choice([1, 2, 5, 36, 37, 38, 39, 74, 75, 200, 1500]))) for _ in range(60)] + [None, "", "12 !", "a"]
    got = model.score_all(texts)
    assert got == [model.score_all([t])[0] for t in texts]  # what else is in the batch does not matter
    for text, (lang, score, evidence) in zip(texts, got, strict=True):
        if not text or not any(map(str.isalpha, text)):
            assert (lang, score, evidence) == ("und", 0.0, 0.0)
            continue
        grams = _grams(text)
        mean = {k: sum(logs(k, g) for g in grams) / len(grams) for k in letters}
        z = {k: mean[k] * min(len(grams), 1000) + math.log((40 if k == "aa" else 10) / 60) for k in letters}
        best = max(sorted(z), key=z.get)
        assert lang == best and score == pytest.approx(1 / sum(math.exp(v - z[best]) for v in z.values()))
        usual = sum(n * logs(best, g) for g, n in counts[best].items()) / sums[best]
        chance = sum(logs(best, g) for g in range(langid.BUCKETS)) / langid.BUCKETS
        assert evidence == pytest.approx(min(1, max(0, (mean[best] - chance) / (usual - chance))), abs=1e-9)


def test_sample_is_bounded_and_evidence_does_not_saturate(spark):
    rows = [(k, "bonjour" if k % 2 else "hello", "fr" if k % 2 else "en") for k in range(300)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=40)
    assert model.languages == ["en", "fr"]
    (lang, _, near), (_, score, far) = model.score_all(["bonjour", "知彼知己百戰不殆" * 20])
    assert lang == "fr" and near > 0.9 and score > 0.5 and far < 0.2


def _slow(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_edit_distance_against_the_table():
    rng = random.Random(1)
    for _ in range(200):
        item, text = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 90))) for _ in "ab")
        assert decontam.edit_distance_within(item, text)[0] == _slow(item, text)


def test_cgk_keeps_near_strings_near():
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(200))
    edited = base[:50] + "x" + base[51:120] + base[122:]
    other = "".join(rng.choice("abcdefgh ") for _ in range(200))
    rows = np.zeros((3, 200), np.uint8)
    for k, s in enumerate((base, edited, other)):
        rows[k, : len(s)] = np.frombuffer(s.encode(), np.uint8)
    near, far = 0, 0
    for seed in range(10):
        e = decontam.cgk(rows, np.array([200, len(edited), 200]), 200, [seed])[:, 0].T
        near, far = near + (e[0] != e[1]).mean(), far + (e[0] != e[2]).mean()
    assert near < 0.6 * far


def _brute(rows, width):
    seen = Counter(t[p : p + width] for _, t in rows for p in range(len(t) - width + 1))
    out = {}
    for k, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[k] = (len(t), int(gone.sum()), int((edge > 0).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("ways", [{}, {"PAIRS": 1}, {"SPLIT": 2}, {"DEAL": 1}, {"DEAL": 1, "PAIRS": 1}])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, ways):
    for k, v in ways.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdef gh") for _ in range(rng.randint(300, 2000))) for _ in range(5)]
    texts = []
    for _ in range(60):
        s = rng.choice(base)
        s = s[rng.randint(0, len(s)) :] + rng.choice(base)[: rng.randint(0, 900)] if rng.random() < 0.5 else s
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            if s:
                s[rng.randrange(len(s))] = rng.choice("xyé")
        texts.append("".join(s))
    texts += ["a" * 2000, "ab" * 500, "", "a" * 399, "a" * 400, base[0], base[0], base[1] * 2]
    rows = [(k, t.encode()) for k, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == _brute(rows, 400)


def test_deep_shallow_sorts_like_sorted():
    rng = random.Random(4)
    for _ in range(60):
        head = bytes(rng.choice(b"ab") for _ in range(64))
        strings = [head + bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 5, 200]))) for _ in range(rng.randint(1, 30))]
        strings += [rng.choice(strings) + b"z" * rng.randint(0, 3) for _ in range(5)]
        order, shared = suffix_dedup.deep_shallow(strings, 64, rng.choice([0, 3, 24]))
        assert [strings[k] for k in order] == sorted(strings)
        assert shared[1:] == [suffix_dedup.common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
