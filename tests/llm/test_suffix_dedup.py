"""Suffix-array deduplication against plain substring counts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tapline.llm import suffix_dedup as S

SCHEMA = "doc_id bigint, text string, mark string, core int"


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(r)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(r), sum(hit), runs, hashlib.sha256(bytes(b for b, h in zip(r, hit, strict=True) if not h)).hexdigest()))
    return out


def run(spark, texts, length, core, ids=None):
    ids = ids or range(len(texts))
    df = spark.createDataFrame([(i, t, "m", 0) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    rows = S.remove_repeats(df, length, core).collect()
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab", "abcdefgh", "aé\0z "])
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 150))) for _ in range(4)]
    texts = [None, "", "ab" * 90, "ab" * 61, "x" * 39]
    for _ in range(40):
        kind = rng.random()
        if kind < 0.2 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.6:
            texts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) + rng.choice(passages) + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))))
        else:
            texts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))))
    return texts


@pytest.mark.parametrize("seed,bucket", [(0, 20_000), (1, 7), (2, 3), (3, 12)])
def test_equal_to_brute_force(spark, monkeypatch, seed, bucket):
    """Small buckets put runs of equal suffixes across boundaries."""
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket)
    texts = corpus(seed)
    want = sorted(((i, *r) for i, r in enumerate(brute(texts, 40))), key=repr)
    assert run(spark, texts, 40, 16) == want


def test_rows_with_equal_or_null_ids(spark):
    long = "".join(random.Random(4).choice("abcd") for _ in range(100))
    texts = [long, long, "q" + long[:60], None, "", "é" * 30]
    want = sorted(((i, *r) for i, r in zip([7, 7, None, None, 0, 3], brute(texts, 40), strict=True)), key=repr)
    assert run(spark, texts, 40, 16, [7, 7, None, None, 0, 3]) == want
    assert run(spark, [], 40, 16) == []


def test_multikey_order_is_the_byte_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [b"same" * 9] * 60
    order, common = S.multikey_order(strings)
    got = [strings[i] for i in order]
    width = max(map(len, strings))
    assert got == sorted(strings, key=lambda s: (s.ljust(width, b"\0"), len(s)))
    for k in range(1, len(got)):
        a, b = got[k - 1], got[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[k] == n


def test_every_window_has_one_anchor_chosen_by_its_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[1500:1900] = data[200:600]
    rows, anchor, first, last = S.anchors_of(data, np.array([0, 1400, 3000]), 100, 30)
    assert sum(last - first + 1) == (1400 - 99) + (1600 - 99)
    place = {s: a - s for a, f, e in zip(anchor, first, last, strict=True) for s in range(f, e + 1)}
    assert all(place[200 + k] == place[1500 + k] for k in range(300))
