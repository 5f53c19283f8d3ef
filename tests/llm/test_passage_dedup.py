"""Compact windows against all passages, and planted repeats."""

import random

import numpy as np
import pytest

from tapline.llm import passage_dedup as D
from tapline.llm.common import mix

SCHEMA = "doc_id bigint, text string, node string, words int"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.mark.parametrize("distinct", [5, 1000])
def test_windows_hold_every_passage_once(distinct):
    rng = np.random.default_rng(distinct)
    tokens = mix(rng.integers(0, distinct, 60).astype(np.uint64))
    rows, least = np.repeat([0, 1], [40, 20]), 6
    hashes = mix(tokens ^ np.uint64(0x9E3779B97F4A7C15))
    place, left, right = D.compact_windows(tokens, rows, 1, least)
    windows = {c: (x, y) for c, x, y in zip(place.tolist(), left.tolist(), right.tolist(), strict=True)}
    for i in range(60):
        j = i + least - 1
        if j < 60 and rows[i] == rows[j]:
            c = i + int(np.argmin(hashes[i : j + 1]))
            assert c - i <= windows[c][0] and j - c <= windows[c][1]


def test_equal_passages_share_a_signature():
    rng = random.Random(1)
    for n in (50, 51, 60, 90):
        passage = words(rng, n)
        sets = []
        for _ in range(2):
            raw = " ".join(words(rng, 80) + passage + words(rng, 70)).encode()
            data = np.frombuffer(raw, np.uint8)
            tokens, rows, _, _ = D.tokens_of(data, np.array([0, len(data)]))
            sets.append(set(D.signatures(tokens, rows, 46, 3)[0].tolist()))
        assert sets[0] & sets[1]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], SCHEMA).repartition(3)
    return D.repeated_passages(df).collect()


def test_planted_passages_are_found_and_others_left(spark):
    rng = random.Random(7)
    rows, groups = [], []
    for g in range(6):
        passage, ids = words(rng, 55 + 10 * g), []
        for _ in range(3):
            near = list(passage)
            if g % 2:
                near[rng.randrange(len(near))] = "edited"
            ids.append(len(rows))
            rows.append((len(rows), " ".join(words(rng, 120) + near + words(rng, 90))))
        groups.append(ids)
    clean = list(range(len(rows), len(rows) + 15))
    rows += [(i, " ".join(words(rng, 200))) for i in clean]
    short = words(rng, 30)
    rows += [(100 + k, " ".join(words(rng, 60) + short + words(rng, 60))) for k in range(4)]
    copy = " ".join(words(rng, 70))
    rows += [(200, copy), (201, copy.upper()), (202, copy), (300, None), (301, ""), (302, "a b c d e f"), (303, "a b c d e f"), (None, " ".join(words(rng, 80)))]
    out = run(spark, rows)
    found = {}
    for r in out:
        assert r["similarity"] >= 0.8 and r["end"] - r["begin"] >= 50 and r["partner_end"] - r["partner_begin"] >= 50 and r["doc_id"] != r["partner_id"]
        for i in (r["doc_id"], r["partner_id"]):
            found.setdefault(i, set()).add(r["class_id"])
    for ids in groups:
        assert all(found.get(i) == {min(ids)} for i in ids), ids
    assert found[200] == found[201] == found[202] == {200}
    assert set(found) == {i for ids in groups for i in ids} | {200, 201, 202}
    assert run(spark, []) == []


def test_hot_signatures_are_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT_ROWS", 3)
    monkeypatch.setattr(D, "SALTS", 4)
    rng = random.Random(8)
    passage = words(rng, 60)
    rows = [(i, " ".join(words(rng, 30) + passage + words(rng, 20))) for i in range(30)]
    out = run(spark, rows)
    assert {i for r in out for i in (r["doc_id"], r["partner_id"])} == set(range(30)) and {r["class_id"] for r in out} == {0}
    assert len(out) < 150


def test_passages_of_two_places():
    rng = np.random.default_rng(3)
    p, q = rng.integers(0, 1 << 30, 60), rng.integers(0, 1 << 30, 70)
    noise = lambda n: rng.integers(1 << 30, 1 << 31, n)
    a = np.concatenate([noise(50), p, noise(200), q, noise(9)])
    b = np.concatenate([q, noise(100), p, noise(80)])
    got = D.passages(a, b, [(60, 180), (320, 10), (61, 181)], 46, 0.8)
    assert [g[:4] for g in got] == [(50, 110, 170, 230), (310, 380, 0, 70)] and all(g[4] == 1 for g in got)


def test_ranges_are_judged_by_marks_and_not_sorted_anew(monkeypatch):
    for sorter in ("isin", "intersect1d"):
        monkeypatch.setattr(np, sorter, lambda *a, **k: pytest.fail("a range is sorted"))
    rng = np.random.default_rng(5)
    line = rng.integers(0, 1 << 60, 30).astype(np.uint64)
    p = np.concatenate([line, line, line])
    a = np.concatenate([rng.integers(0, 1 << 60, 40).astype(np.uint64), p])
    b = np.concatenate([p, rng.integers(0, 1 << 60, 50).astype(np.uint64)])
    got = D.passages(a, b, [(k, k - 40) for k in range(45, 125, 7)], 46, 0.8)
    assert got
    for x0, x1, y0, y1, said in got:
        x, y = set(a[x0:x1].tolist()), set(b[y0:y1].tolist())
        assert min(x1 - x0, y1 - y0) >= 46 and said == len(x & y) / len(x | y) >= 0.8


def classes(spark, rows):
    found = {}
    for r in run(spark, rows):
        for i in (r["doc_id"], r["partner_id"]):
            found.setdefault(i, set()).add(r["class_id"])
    return found


def test_members_that_their_leader_does_not_link_meet_each_other(spark):
    """Two texts have a passage of 52 words, and 42 words of it stand in three shorter texts."""
    rng = random.Random(11)
    rows, pairs = [], []
    for _ in range(60):
        line = words(rng, 42)
        passage, pair = line + words(rng, 10), (len(rows), len(rows) + 1)
        rows += [(i, " ".join(words(rng, 90) + passage + words(rng, 90))) for i in pair]
        rows += [(len(rows) + k, " ".join(words(rng, 20 + 10 * k) + line + words(rng, 30))) for k in range(3)]
        pairs.append(pair)
    found = classes(spark, rows)
    assert all(found.get(i) == {pair[0]} for pair in pairs for i in pair)
    assert set(found) == {i for pair in pairs for i in pair}


def test_a_passage_whose_words_stand_alone_before_it(spark):
    rng = random.Random(12)
    rows, pairs = [], []
    for g in range(8):
        passage, pair = words(rng, 52), (2 * g, 2 * g + 1)
        rows += [(i, " ".join(words(rng, 30) + passage[:35] + words(rng, 60) + passage[17:] + words(rng, 60) + passage + words(rng, 30))) for i in pair]
        pairs.append(pair)
    found = classes(spark, rows)
    assert all(found.get(i) == {pair[0]} for pair in pairs for i in pair)


def test_rest_pairs_leave_out_a_line_between_other_words(spark):
    """Documents that have a line of 30 words and no more in common are not compared with each other."""
    rng = random.Random(13)
    line = words(rng, 30)
    texts = [" ".join(words(rng, 60) + line + words(rng, 60)) for _ in range(20)]
    passage = line + words(rng, 25)
    texts += [" ".join(words(rng, 90) + passage + words(rng, 60)) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    nodes = D.node_rows(docs).select("node", D.F.col("doc_id").alias("rep"), "words", D.F.lit(1).alias("copies")).cache()
    windows = D.window_rows(docs, 46, 1, 0.8).cache()
    pairs, members = D.meetings(windows, spark.createDataFrame([], "signature bigint"))
    held = D._texts(docs, nodes, members.select("node").distinct(), 46, 1, 0.8)
    alone = nodes.select("node", D.F.col("node").alias("component"))
    ids = {r["node"]: r["rep"] for r in nodes.collect()}
    assert pairs.count() >= 20
    assert {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in D.rest_pairs(D.dense_places(members, alone, held, 46, 0.8), alone, False)[0].collect()} == {(20, 21)}


def test_rest_pairs_leave_out_words_that_are_repeated_in_both(spark):
    """Texts of words repeated many times that have one such word in common, too few times for a passage, don't meet."""
    rng = random.Random(14)
    texts = []
    for k in range(20):
        before, after = ("".join(f"{side}{k}x{w} " * 60 for w in range(3)) for side in "ab")
        texts.append(before + "the " * rng.randint(30, 40) + after)
    texts += ["the " * 60 + " ".join(words(rng, 60)) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    nodes = D.node_rows(docs).select("node", D.F.col("doc_id").alias("rep"), "words", D.F.lit(1).alias("copies")).cache()
    _, members = D.meetings(D.window_rows(docs, 46, 1, 0.8), spark.createDataFrame([], "signature bigint"))
    held = D._texts(docs, nodes, members.select("node").distinct(), 46, 1, 0.8)
    alone = nodes.select("node", D.F.col("node").alias("component"))
    ids = {r["node"]: r["rep"] for r in nodes.collect()}
    dense = D.dense_places(members, alone, held, 46, 0.8)
    assert dense.count() > 2
    assert {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in D.rest_pairs(dense, alone, False)[0].collect()} == {(20, 21)}
