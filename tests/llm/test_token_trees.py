"""Trees of token counts that are kept in a table and edited by a later job; shards of token files."""

import random

from tokenizers import Tokenizer

from strataspark.llm import token_counts as C
from strataspark.llm import token_files as T
from strataspark.llm.tokens import default_path

WORDS = ["the", "of", "naïve", "x1", "don't", "1234", "ß", "  two", "\n", "long" * 9, "<|endoftext|>", "a"]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _tokens(text, cache=[]):
    if not cache:
        t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        cache.append(t)
    return len(cache[0].encode(text, add_special_tokens=False).ids)


def test_a_second_job_encodes_only_what_edits_touch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, _text(rng, rng.choice([0, 1, 5, 800]))) for k in range(30)] + [(90, None), (91, ""), (None, "no id")]
    C.token_trees(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(f"{tmp_path}/0")
    now, texts = spark.read.parquet(f"{tmp_path}/0"), {k: t or "" for k, t in rows}
    kept = {r["doc_id"]: r["n_tokens"] for r in now.collect()}
    for job in range(1, 4):
        edits = []
        for k in rng.sample(range(30), 8) + [90, 91, 12345]:
            for place in range(rng.choice([1, 3])):
                at = rng.randrange(0, 400)
                edits.append((k, place, at, at + rng.randrange(12), rng.choice(["", "new words ", " ", "x", None])))
        changed = C.edit_trees(now, spark.createDataFrame(edits, "doc_id long, place int, start int, end int, text string"))
        C.merged_trees(now, changed).write.parquet(f"{tmp_path}/{job}")
        for k, _, start, end, text in sorted(edits, key=lambda e: (e[0], e[1])):
            if k in texts:
                old = texts[k]
                start = min(max(start, 0), len(old))
                end = min(max(end, start), len(old))
                texts[k] = old[:start] + (text or "") + old[end:]
        touched = {r["doc_id"]: r for r in changed.collect()}
        assert touched.keys() == {e[0] for e in edits} - {12345}
        assert all(r["n_recounted"] < 120 for r in touched.values())  # of some 800 pieces
        now = spark.read.parquet(f"{tmp_path}/{job}")
        got = {r["doc_id"]: (r["text"], r["n_tokens"]) for r in now.collect()}
        assert got.keys() == texts.keys()
        for k, text in texts.items():
            assert got[k][0] == text
            if k in touched:
                kept[k] = _tokens(text) if "<|" not in text else got[k][1]
            assert got[k][1] == kept[k]
    whole = {r["doc_id"]: r["n_tokens"] for r in C.token_counts(spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")).collect()}
    assert whole == {k: v[1] for k, v in got.items()}


def test_rows_of_one_id_fill_many_shards(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 20)
    rows = [(7, f"text number {k}") for k in range(300)] + [(None, f"none {k}") for k in range(60)] + [(k, "few") for k in range(5)]
    files = T.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    sizes = [r["n"] for r in files.selectExpr("shard", "length(doc_ids) / 8 as n").groupBy("shard").sum("n").toDF("shard", "n").collect()]
    assert len(sizes) > 10 and max(sizes) < 80
    got = T.read_token_files(files).orderBy("start").collect()
    assert len(got) == len(rows) and [r["doc_id"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
