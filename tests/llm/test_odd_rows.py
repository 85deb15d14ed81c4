"""Every operator on odd rows and on an empty table."""

import pytest

from strataspark.llm import bpe, decontam, exact_dedup, langid, licenses, pii, secrets, simhash, suffix_dedup, token_counts, token_files

OPERATORS = {
    "licenses": licenses.license_scan,
    "exact": exact_dedup.exact_dedup,
    "secrets": secrets.secret_scan,
    "simhash": simhash.simhash_components,
    "near": simhash.near_duplicates,
    "files": token_files.token_files,
    "counts": lambda d: token_counts.token_counts(d, token_counts.trial_edits()),
    "language": langid.language_id,
    "bpe": bpe.bpe_digests,
    "bpe_whole": bpe.bpe_encode_decode,
    "suffix": suffix_dedup.suffix_dedup,
    "personal": pii.personal_data,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(odd, name):
    got = OPERATORS[name](odd).collect()
    want = [r["doc_id"] for r in odd.collect()]
    assert sorted((r["doc_id"] for r in got), key=str) == sorted(want, key=str)
    null = [r for r in got if r["doc_id"] == 3][0].asDict()
    empty = [r for r in got if r["doc_id"] == 4][0].asDict()
    keep = {"start", "doc_id", "component_id", "held_out"}  # what names the row itself
    if name == "near":
        assert null["component_id"] == 3 and empty["component_id"] == 4
    elif name == "exact":
        assert (null["keep_id"], empty["keep_id"], null["group_size"]) == (3, 3, 2)
    else:
        assert {k: v for k, v in null.items() if k not in keep} == {k: v for k, v in empty.items() if k not in keep}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, name):
    assert OPERATORS[name](none).count() == 0


def test_leaks_on_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "renard brun saute par dessus le chien paresseux"), (2, None), (3, ""), (4, "123")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(odd, items).collect()}
    assert got == {(7, 1), (8, 4)}
    assert decontam.leaks(none, items).count() == 0
    assert decontam.leaks(odd, items.filter("item_id > 9")).count() == 0


INSIDE = ["__id", "__digest", "__keep", "__sha", "__n", "__t", "__first", "__hash", "__leak", "__text", "lang_pred", "evidence", "score", "held_out", "own", "row", "c0", "C1", "head", "first"]


def test_stages_keep_columns_of_any_name(spark, odd):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = odd.drop("score", "held_out").select("*", *[F.lit(k).alias(c) for k, c in enumerate(INSIDE)])
    items = spark.createDataFrame([(1, "renard brun saute par dessus le chien paresseux")], "item_id long, text string")
    gone = {"keep_first": (exact_dedup.keep_first(docs), {2, 4, 5, 10}), "near": (simhash.keep_first_of_near(docs), {2, 10}), "leaks": (decontam.without_leaks(docs, items), {7}), "language": (corpus_pipeline.language(spark, docs, ""), {3, 4, 5, 8})}
    every = {r["doc_id"] for r in docs.collect()}
    for name, (kept, want) in gone.items():
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert {r["lang_pred"] for r in rows} == {INSIDE.index("lang_pred")}
        assert every - {r["doc_id"] for r in rows} >= want & (every - {4, 5}) and (name != "leaks" or every - {r["doc_id"] for r in rows} == want)
