"""Integers beside nulls, and columns of the user that are named like results."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import decontam, idfile, jaccard, licenses, packing, quality, store, warc

BIG = 9_007_199_254_740_993  # the first integer that a double cannot hold
KEYS = [BIG, None, BIG + 2, BIG + 4]
TEXT = "the quick brown fox jumps over the lazy dog and then sleeps under the old apple tree for hours"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, TEXT + " again" * i, BIG + 10 if i else None) for i, k in enumerate(KEYS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "jumps over the lazy dog and then sleeps under the old")], "item_id long, text string")


def keys(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=lambda k: (k is not None, k))


EXPECTED = [None, BIG, BIG + 2, BIG + 4]


def test_keys_beside_nulls(spark, docs, benchmark):
    model = quality.train([])
    assert keys(quality.score_ids(docs, model)) == EXPECTED
    scored = quality.score(docs, model)
    assert keys(scored) == EXPECTED and {r["n_chars"] for r in scored.collect()} == {None, BIG + 10}
    assert keys(licenses.scan_licenses(docs)) == EXPECTED
    assert keys(decontam.find_benchmark(docs, benchmark)) == EXPECTED
    cleaned = decontam.find_benchmark(docs, benchmark, clean=True)
    assert keys(cleaned) == EXPECTED and {r["n_chars"] for r in cleaned.collect()} == {None, BIG + 10}
    similar = jaccard.similar_documents(docs)
    assert keys(similar) == EXPECTED
    assert set(keys(similar, "class_id")) <= set(EXPECTED)
    assert keys(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))) == EXPECTED


def test_token_files_beside_nulls(spark, docs):
    folder = store.shared_folder(spark, "ids")
    files = idfile.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    assert keys(idfile.read_token_files(spark, folder, files)) == EXPECTED


@pytest.mark.parametrize("with_null", [True, False])
def test_bundles_beside_nulls(spark, with_null):
    same = "x" * 2000
    rows = [(BIG, "u", same), (BIG + 2, "u", same), (BIG + 4, None, same), (BIG + 6, "u", "small"), (1, "u", "y" * 1500)] + [(None, "u", "other" * 300)] * with_null
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = store.shared_folder(spark, "warc")
    index = warc.write_bundles(pages, folder)
    found = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(spark, folder).collect()}
    expected = {(BIG, "revisit", BIG + 4), (BIG + 2, "revisit", BIG + 4), (BIG + 4, "response", None), (BIG + 6, "response", None), (1, "response", None)}
    assert found == expected | ({(None, "response", None)} if with_null else set())
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.fetch_records(folder, index).collect()} == found
    assert {r["key"] for r in index.collect()} == {r[0] for r in rows}


def test_stages_keep_columns_of_the_user(spark, tmp_path, docs, benchmark):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["score", "n_lines", "n_removed", "n_hit", "items", "Mark", "spans"]
    own = docs.withColumns({c: F.lit(f"my {c}") for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, str(tmp_path))
        assert out.columns == own.columns
        rows = out.collect()
        assert rows and all(r[c] == f"my {c}" for r in rows for c in names)
        assert {r["doc_id"] for r in rows} <= set(EXPECTED)


def test_shared_folder_only_local_without_setting(spark, monkeypatch):
    assert store.shared_folder(spark, "x") != store.shared_folder(spark, "x")
