"""Language identification: held-out accuracy, calibration, sparsity and odd rows."""

import zlib

import numpy as np
import pytest

from tapline.llm import language as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return {r["doc_id"]: r for r in L.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()}


def test_held_out_rows_are_told_apart(found):
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [r for r in found.values() if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_scores_are_probabilities(found):
    held = [r for r in found.values() if r["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    right = np.array([r["lang_pred"] == r["lang"] for r in held])
    assert abs(right.mean() - np.mean([r["score"] for r in held])) < 0.05


def test_weights_are_sparse(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs, per_language=60)
    assert 0 < (model.weights != 0).mean() < 0.5


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, score string, lang_pred int"
    rows = [(1, None, "en", "s", 1), (2, "", "en", "s", 1), (3, "12 34 !", "de", "s", 1), (4, "the thing", None, "s", 1), (None, "the thing", "en", "s", 1), (5, "the other thing", "en", "s", 1), (5, "the other thing", "en", "s", 1), (8, "das ding " * 90_000, "de", "s", 1)]
    out = L.identify(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert all(r["lang_pred"] in ("en", "de") for r in out if r["doc_id"] not in (1, 2, 3))
    assert L.identify(spark.createDataFrame([], schema)).collect() == []
    untaught = L.identify(spark.createDataFrame([(1, "text", None, "s", 1)], schema)).collect()
    assert untaught[0]["lang_pred"] == "und"
    docs = spark.createDataFrame(rows, schema)
    kept = L.accepted(docs, L.fit(docs.where("doc_id <> 4")))
    assert kept.columns == docs.columns and 1 <= kept.count() <= 5


def test_parts_of_a_long_text_count_every_ngram_once(monkeypatch):
    text = "Ab cdé fgh ij" * 5
    whole = L._counts(text)
    for part in (1, 2, 3, 7):
        monkeypatch.setattr(L, "_PART", part)
        got = L._counts(text)
        assert np.array_equal(whole[0], got[0]) and np.array_equal(whole[1], got[1])
    assert whole[1].sum() == sum(len(text) - k for k in range(3))
