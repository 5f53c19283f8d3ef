"""The pipeline's stages against plain loops over the small tables."""

import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tapline.llm import decontaminate as D
from test_jaccard_join import brute as components

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(str(r["item_id"]), D.words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    automaton = D.Automaton([x for x in bench if x[1]])
    found = [docs]
    for _, step in corpus_pipeline.STAGES:
        found.append(step(spark, found[-1], SF).cache())
    assert all(df.columns == docs.columns for df in found[1:-1])
    before, known, single, clean, private = (rows(df) for df in found[:5])
    assert known.items() <= before.items() and len(known) > 0.95 * len(before)
    want = {c for i, n, c in components(sorted(known.items())) if n} | {i for i, n, c in components(sorted(known.items())) if not n}
    assert set(single) == want and single.items() <= known.items()
    for i, text in single.items():
        runs, _ = automaton.scan(D.words_of(text))
        if not runs:
            assert clean[i] == text
        elif i in clean:
            assert not automaton.scan(D.words_of(clean[i]))[0]
    assert set(private) == set(clean)
    mail = re.compile(r"[\w.+-]+@mail\d")
    assert any(mail.search(t) for t in clean.values()) and not any(mail.search(t) for t in private.values())
    assert all(private[i] == t for i, t in clean.items() if not re.search(r"\d|@", t))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in found[-1].collect():
        assert r["ids"] == sp.encode(private[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["text"] == private[r["doc_id"]]


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and {"doc_id", "n_tokens"} <= set(out.columns)
