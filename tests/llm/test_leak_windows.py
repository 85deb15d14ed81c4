import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from strataspark.llm import decontam


def _word(rng):
    return "".join(rng.choice(["th", "er", "on", "an", "ing", "re", "st"]) for _ in range(rng.randint(1, 4)))


def _cut(rng, length):
    text = ""
    while len(text) < length:
        text += _word(rng) + " "
    return text[:length].strip()


@pytest.mark.parametrize("share", [0.1, 0.15, 0.19])
def test_items_of_mixed_length_with_edits_at_the_head(share):
    rng = random.Random(8)
    items = [(k, _cut(rng, 81 if k % 3 == 0 else rng.randint(300, 394))) for k in range(60)]
    alone = {}
    for batch in (items, [items[1]]):  # what else is looked at does not matter
        scanner = decontam._Scanner(decontam.Items(batch))
        texts = []
        for k, t in batch:
            head = int(share * len(t)) if k % 3 else 0
            host = " ".join("zq" + "".join(rng.choice("bcdfgkmpx") for _ in range(5)) for _ in range(40))
            texts.append(decontam.plain(f"{host} {''.join(rng.choice('qxzjvw') for _ in range(head))}{t[head:]} {host}") + b" \0 ")
        scanner.propose([k for k, _ in batch], texts)
        alone[len(batch)] = {(d, i) for d, i, _, _ in scanner.verified()}
    assert {(k, k) for k, _ in items} <= alone[60]
    assert alone[1] == {(1, 1)}


def _letters(text):
    """Upper to lower case, one space for what is neither letter nor digit."""
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def _least_edits(item, texts):
    """Least edit distance of the item to any part of each text, row by row of the whole table."""
    n = max(map(len, texts))
    rows = np.array([[ord(c) for c in t.ljust(n, "\0")] for t in texts], np.int32)
    at = np.arange(n + 1)
    before = np.zeros((len(texts), n + 1), np.int32)
    for k, c in enumerate(item, 1):
        now = before + 1
        now[:, 1:] = np.minimum(now[:, 1:], before[:, :-1] + (rows != ord(c)))
        now[:, 0] = k
        before = np.minimum.accumulate(now - at, axis=1) + at
    return before.min(1)


def _with_edits(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice(text) + text[k:], text[:k] + rng.choice(text) + text[k + 1 :]])
    return text


@pytest.mark.parametrize("share", [0, 0.1, 0.15, 0.2])
def test_recall_against_all_pairs_by_a_plain_distance(spark, share):
    rng = random.Random(int(100 * share))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect()]
    plain = [_letters(t) for _, t in items]
    docs = []
    for k in range(3 * len(items)):
        host = " ".join("".join(rng.choice(["th", "er", "on", "an", "ing", "re", "st", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(25))
        own = plain[k % len(items)]
        docs.append((k, f"{host} {_with_edits(rng, own, int(share * len(own))).upper()}, {host}" if k < 2 * len(items) else host))
    read = [_letters(t) for _, t in docs]
    want = {(d, items[i][0]) for i, t in enumerate(plain) for d in np.flatnonzero(_least_edits(t, read) <= int(0.2 * len(t))).tolist()}
    rows = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(want) >= 2 * len(items) * 0.9
    assert got <= want
    print(f"recall at {share}: {len(got)} of {len(want)}")
    assert len(got) >= (1 if share == 0 else 0.9) * len(want), f"{len(got)} of {len(want)}"


def _letters_replaced(rng, text, n, place):
    """``n`` letters replaced: anywhere, or one a word as far as that goes, at any place or at a fixed one."""
    if place is None:
        text = list(text)
        for k in rng.sample(range(len(text)), n):
            text[k] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        return "".join(text)
    words, done, first = [list(w) for w in text.split(" ")], 0, True
    order = list(range(len(words)))
    while done < n:
        rng.shuffle(order)
        for k in order[: n - done]:
            words[k][min(place, len(words[k]) - 1) if first and place >= 0 else rng.randrange(len(words[k]))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
            done += 1
        first = False
    return " ".join(map("".join, words))


@pytest.mark.parametrize("place", [None, -1, 1], ids=["anywhere", "one a word", "second letter"])
@pytest.mark.parametrize("share", [0.12, 0.15, 0.18, 0.2])
def test_recall_of_letters_spread_over_all_words(share, place):
    rng = random.Random(3)
    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.1/benchmark.parquet").to_pylist()]
    plain = [_letters(t) for _, t in items]
    scanner = decontam._Scanner(decontam.Items(items))
    host = " ".join(_word(rng) for _ in range(30))
    texts = [decontam.plain(f"{host} {_letters_replaced(rng, t, int(share * len(t)), place)} {host}") + b" \0 " for t in plain]
    scanner.propose(list(range(len(texts))), texts)
    got = {(d, i) for d, i, _, _ in scanner.verified()}
    want = {(k, items[k][0]) for k, t in enumerate(plain) if _least_edits(t, [texts[k].decode()])[0] <= int(0.2 * len(t))}
    assert len(want) >= 0.95 * len(items)
    print(f"recall at {share}: {len(got & want)} of {len(want)}")
    assert len(got & want) >= 0.9 * len(want), f"{len(got & want)} of {len(want)}"


def test_grams_of_very_many_items_are_looked_at_in_halves(monkeypatch):
    rng = random.Random(5)
    items = [(k, f"what is the question of the day {_cut(rng, 60)} what is the question") for k in range(20)]
    filler = "what is the question of the day " * 12
    texts = [decontam.plain(f"{filler} {items[k][1]} {filler}") + b" \0 " for k in (3, 15)]
    found = []
    for hits in (decontam.HITS, 300):
        monkeypatch.setattr(decontam, "HITS", hits)
        monkeypatch.setattr(decontam, "LEAST_PIECE", 256)
        scanner = decontam._Scanner(decontam.Items(items))
        scanner.propose([3, 15], texts)
        assert {(d, k) for d, k, _, _ in scanner.rows} >= {(3, 3), (15, 15)}
        found.append({(d, i) for d, i, e, _ in scanner.verified() if e == 0})
    assert found[0] == found[1] == {(3, 3), (15, 15)}


def test_items_under_a_gram_leak_as_whole_words():
    items = [(1, "ab"), (2, "ab cd"), (3, "cd"), (4, "ab"), (5, "x y z w")]
    scanner = decontam._Scanner(decontam.Items(items))
    texts = [decontam.plain(t) + b" \0 " for t in ("zab cd", "ab-cd", "X, y; z w!", "abc")]
    assert {(d, i) for d, i, _, _ in scanner.propose([10, 11, 12, 13], texts)} == {(10, 3), (11, 1), (11, 2), (11, 3), (11, 4), (12, 5)}


HAN = "".join(map(chr, range(0x4E00, 0x4E00 + 2000)))
THAI = "".join(map(chr, [*range(0x0E01, 0x0E3A), *range(0x0E40, 0x0E4E)]))


@pytest.mark.parametrize("letters,size", [(HAN, 40), (HAN, 3), (THAI, 60), ("abcdefghijklmnopqrstuvwxyz0123456789", 64), ("abcdefghijklmnopqrstuvwxyz0123456789", 20)])
@pytest.mark.parametrize("before", ["", "。", "「", "—"])
def test_a_verbatim_passage_in_a_run_without_spaces(letters, size, before):
    rng = random.Random(4)
    run = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(k, run(size)) for k in range(10)]
    scanner = decontam._Scanner(decontam.Items(items))
    texts = [decontam.plain(f"{run(rng.randint(1, 90))}{before}{t}{run(50)}") + b" \0 " for _, t in items]
    found = scanner.propose([k for k, _ in items], texts) + scanner.verified()
    assert {(d, i, e) for d, i, e, _ in found} >= {(k, k, 0) for k in range(10)}


def test_marks_beyond_ascii_part_words_and_vowel_signs_do_not():
    assert decontam.plain("“Hé”—l’eau…fin").decode() == "hé l eau fin"
    assert decontam.plain("好。「吗」").decode() == "好 吗"
    assert decontam.plain("ที่นี่").decode() == "ที่นี่"


def test_rows_that_share_an_id_or_have_none_go_by_their_text(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(1, f"before {item} after"), (1, "a clean text"), (None, item), (None, "another clean text"), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, item_id int")
    kept = decontam.without_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == [1, 3, 4, 5]


def test_a_very_long_text_and_ties(spark):
    rng = random.Random(6)
    item = _cut(rng, 150)
    long = " ".join(_word(rng) for _ in range(300_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long} {item}"), (2, item), (2, item), (3, "x" * 1_000_000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item), (7, item)], "item_id long, text string")
    rows = [(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.leaks(docs, items).collect()]
    assert sorted(rows) == [(1, 7, 0), (1, 8, 0), (2, 7, 0), (2, 8, 0)]
