import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strataspark.llm import bpe, token_counts, token_files, tokens
from strataspark.llm.tokens import byte_encoder, default_path

BYTE = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
WORD = Tokenizer.from_file(default_path("word_bpe_49k.json"))
PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "the", " there", "don't", "'s", ",", ".", "é", "ñandú", "12", "Σ", "İ", "日本", "🙂", "\x1c", "\x85", "\xa0", "x", "A", "<|endoftext|>", "<|startoftext|>", "ﬁ", "é"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_byte_ids_are_the_librarys(text):
    assert np.frombuffer(byte_encoder(None).encode(text), "<u4").tolist() == BYTE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_word_ids_and_decoding_are_the_librarys(text):
    ids = bpe.word_bpe(None).encode(text)
    want = WORD.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert bpe.word_bpe(None).decode(ids) == WORD.decode(want, skip_special_tokens=False)


def test_a_memo_follows_what_is_asked(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 2000)
    made = []
    memo = tokens.Memo(lambda x: made.append(x) or x.encode())
    for k in range(300):
        assert memo[f"w{k}"] == b"w%d" % k
        assert memo["often"] == b"often"
        assert len(memo) + len(memo.old) <= 2 * 2000 // tokens.MEMO_ENTRY
    assert made.count("often") == 1 and len(made) == 301
    assert memo["x" * 500] == b"x" * 500 and "x" * 500 not in memo


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, offsets = token_files.encode(v)
    assert np.array_equal(token_files.decode(words), v)
    for g, at in enumerate(offsets.tolist()):
        end = int(offsets[g + 1]) if g + 1 < len(offsets) else len(words)
        assert np.array_equal(token_files.decode(words[at:end]), v[g * token_files.GROUP : (g + 1) * token_files.GROUP])


@pytest.mark.parametrize("values", [[0] * 1000, [1] * 300, [2**60 - 1, 2**60, 15 << 60], [0] * 240 + [5]])
def test_simple8b_selectors(values):
    words, _ = token_files.encode(np.array(values, np.uint64))
    assert token_files.decode(words).tolist() == values
    assert len(words) <= len(values) + sum(v >= 2**60 for v in values)


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 300)
    rng = random.Random(3)
    rows = [(k * 3, " ".join(rng.choice(["river", "stone", "élan", "x,", "42."]) for _ in range(rng.randint(0, 200)))) for k in range(80)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files = token_files.write_token_files(df)
    got = {r["doc_id"]: r for r in token_files.read_token_files(files).collect()}
    at = 0
    for doc_id, text in sorted(rows):
        ids = [*BYTE.encode(text, add_special_tokens=False).ids, 2]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for block in files.collect():
        for doc_id in np.frombuffer(block["doc_ids"], "<i8").tolist()[:3]:
            ids = token_files.document_ids(block, doc_id)
            assert zlib.crc32(ids.astype("<u4").tobytes()) == got[doc_id]["ids_crc32"]


def test_token_files_stay_where_they_are_asked_to(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k} " * k) for k in range(20)], "doc_id long, text string")
    to = f"{tmp_path}/ids"
    token_files.write_token_files(df, to=to)
    again = token_files.open_token_files(spark, to)
    assert sorted(token_files.read_token_files(again).collect()) == sorted(token_files.token_files(df).collect())
    blocks = [r.asDict() for r in again.collect()]
    ids = next(i for b in blocks if (i := token_files.document_ids(b, 7)) is not None)
    assert ids.tolist() == [*BYTE.encode("text 7 " * 7, add_special_tokens=False).ids, 2]
    with pytest.raises(Exception, match="(?i)already exists"):
        token_files.write_token_files(df, to=to)


def test_word_bpe_on_rows(spark):
    texts = ["Hello, WORLD  it's", "", "Ärger über Öl 2024"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r for r in bpe.bpe_encode_decode(df).collect()}
    for r in bpe.bpe_digests(df).collect():
        ids = WORD.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert whole[r["doc_id"]]["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(WORD.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edits_recount_only_what_they_touch():
    rng, encoder = random.Random(8), byte_encoder(None)
    parts = [" a", " there", "\n", "  ", ",", ".", "é", " 12", "don't", " "]
    for size in (0, 3, 50, 3000):
        text = "".join(rng.choice(parts) for _ in range(size))
        tree = token_counts.CountTree(text, encoder)
        for _ in range(40):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 5, 300]))
            new = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 4, 200])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text and tree.length == len(text)
            assert tree.total == len(BYTE.encode(text, add_special_tokens=False).ids)
    tree = token_counts.CountTree("some words here and there " * 5000, encoder)
    tree.recounted = 0
    tree.edit(60_000, 60_003, "new words")
    assert tree.recounted < 12


def test_token_counts_on_rows(spark):
    df = spark.createDataFrame([(1, "one two three " * 50)], "doc_id long, text string")
    r = token_counts.token_counts(df, token_counts.trial_edits()).head()
    t = "one two three " * 50
    n = len(t)
    t = t[: n // 2] + " revised," + t[n // 2 :]
    t = t[: n // 4] + t[n // 4 + 7 :]
    t = t[:n] + "\n\nRevised edition." + t[n + 1 :]
    assert r["n_tokens_edited"] == len(BYTE.encode(t, add_special_tokens=False).ids) and r["n_edits"] == 3
