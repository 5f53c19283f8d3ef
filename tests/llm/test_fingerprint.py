"""Syncmer fingerprints: context-free anchors, order of rows, edited texts and likeness."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tapline.llm import fingerprint as P

SCHEMA = "doc_id bigint, text string, fingerprint int, part string, place string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8))) for _ in range(n))


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def test_anchors_don_t_depend_on_the_context(monkeypatch):
    rng = random.Random(1)
    passage = words(rng, 80)
    alone, hashes = P.syncmers(points(passage))
    before = words(rng, 30)
    inside, all_hashes = P.syncmers(points(before + passage + words(rng, 20)))
    known = dict(zip(inside.tolist(), all_hashes.tolist(), strict=True))
    assert all(known[p + len(before)] == h for p, h in zip(alone.tolist(), hashes.tolist(), strict=True)) and len(alone) > 40
    monkeypatch.setattr(P, "PART", 37)
    again, more = P.syncmers(points(passage))
    assert np.array_equal(alone, again) and np.array_equal(hashes, more)


def test_a_closed_syncmer_has_its_least_part_at_an_edge():
    text = points(words(random.Random(2), 40))
    inner = P._rolled(text.astype(np.uint64), P.S, 1)
    width = P.K - P.S + 1
    want = [i for i in range(len(text) - P.K + 1) if min(inner[i : i + width]) in (inner[i], inner[i + width - 1])]
    assert P.syncmers(text)[0].tolist() == want


def test_likeness():
    rng = random.Random(3)
    text, other = words(rng, 600), words(rng, 600)
    own = P.sketch(text)
    assert P.read(P.written(own))[0] == len(text) and all(np.array_equal(x, y) for x, y in zip(own[1:], P.read(P.written(own))[1:], strict=True))
    assert P.likeness(own, P.sketch(text)) == 1
    assert P.likeness(own, P.sketch(other)) < 0.05
    assert 0.5 < P.likeness(own, P.sketch(P.edited(text, other))) < 0.85
    assert P.likeness(own, P.sketch("x " + text)) > 0.9
    assert P.likeness(P.sketch(""), P.sketch("")) == 1 and P.likeness(P.sketch(""), own) == 0 and P.likeness(P.sketch("ab"), P.sketch("ab")) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_rows_equal_a_plain_loop(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(60), rng.choice([None, "", "é", words(rng, rng.randint(1, 60))])) for _ in range(n)]
    if n == 40:
        rows += [(None, "no id"), (None, None), (7, "twice"), (7, "twice"), (-5, "below")]
    df = spark.createDataFrame([(i, t, 1, "p", "q") for i, t in rows], SCHEMA).repartition(3)
    out = P.compared(df).collect()
    mark = {r["text"]: r["m"] for r in df.selectExpr("coalesce(text, '') text", "xxhash64(coalesce(text, '')) m").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), mark[r[1]]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        new = P.edited(t, after)
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), P.written(P.sketch(t)), P.written(P.sketch(new)), P.likeness(P.sketch(t), P.sketch(new)), P.likeness(P.sketch(t), P.sketch(after))))
    assert Counter(map(tuple, out)) == Counter(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
