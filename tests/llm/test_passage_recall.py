"""Edited passages against the similarity of the passages themselves."""

import numpy as np
import pytest

from tapline.llm import passage_dedup as D
from tapline.llm.common import shingle_hashes

LEAST, SIMILAR = 46, 0.8


def tokens(words):
    return shingle_hashes(words, np.zeros(len(words), np.int64), D.SHINGLE)[0]


def fresh(rng, n):
    return rng.integers(0, 1 << 62, n).astype(np.uint64)


def edited(rng, words, kind, at):
    if kind == "insert":
        return np.insert(words, at, fresh(rng, 1))
    if kind == "delete":
        return np.delete(words, at)
    out = words.copy()
    out[at] = fresh(rng, 1)[0]
    return out


def likeness(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


@pytest.mark.parametrize("kind", ["change", "insert", "delete"])
def test_an_edit_near_the_end_of_a_passage(kind):
    rng = np.random.default_rng(1)
    for at in range(0, 56, 3):
        passage = fresh(rng, 56)
        near = edited(rng, passage, kind, at)
        a, b = tokens(np.concatenate([fresh(rng, 80), passage, fresh(rng, 70)])), tokens(np.concatenate([fresh(rng, 30), near, fresh(rng, 90)]))
        assert likeness(tokens(passage), tokens(near)) >= SIMILAR
        _, in_a, in_b = np.intersect1d(a, b, return_indices=True)
        for anchor in (0, len(in_a) // 2):
            got = D.passages(a, b, [(int(in_a[anchor]), int(in_b[anchor]))], LEAST, SIMILAR)
            x0, x1, y0, y1, said = got[0]
            assert min(x1 - x0, y1 - y0) >= LEAST and said == likeness(a[x0:x1], b[y0:y1]) >= SIMILAR


@pytest.mark.parametrize("share", [0.025, 0.04])
def test_a_copy_with_many_edits_keeps_its_parts(share):
    rng = np.random.default_rng(2)
    words = fresh(rng, 1000)
    near = words.copy()
    near[rng.choice(np.setdiff1d(np.arange(1000), np.arange(480, 560)), int(1000 * share), replace=False)] = fresh(rng, int(1000 * share))
    a, b = tokens(words), tokens(near)
    got = D.passages(a, b, [(k, k) for k in np.flatnonzero(a == b).tolist()], LEAST, SIMILAR)
    assert any(x0 <= 485 and x1 >= 550 for x0, x1, *_ in got)
    assert all(said == likeness(a[x0:x1], b[y0:y1]) >= SIMILAR for x0, x1, y0, y1, said in got)


def test_whole_equal_texts_and_parts_in_another_order():
    rng = np.random.default_rng(3)
    a = fresh(rng, 200)
    assert D.passages(a, a, [(90, 90)], LEAST, SIMILAR) == [(0, 200, 0, 200, 1.0)]
    b = np.concatenate([fresh(rng, 60), a[30:60], a[:30], fresh(rng, 60)])
    assert D.passages(a, b, [(10, 100)], LEAST, SIMILAR)


@pytest.mark.parametrize("kind", ["change", "insert", "delete"])
def test_edited_passages_share_a_signature(kind):
    rng = np.random.default_rng(4)
    met = tried = 0
    for _ in range(200):
        passage = fresh(rng, 56)
        near = edited(rng, passage, kind, int(rng.integers(0, 56)))
        if likeness(tokens(passage), tokens(near)) < SIMILAR:
            continue
        tried += 1
        sides = [tokens(np.concatenate([fresh(rng, 80), p, fresh(rng, 70)])) for p in (passage, near)]
        keys = [D.signatures(t, np.zeros(len(t), np.int64), LEAST, D.HASHES)[0] for t in sides]
        met += len(np.intersect1d(*keys)) > 0
    assert tried > 150 and met >= 0.98 * tried


@pytest.mark.parametrize("least,similar,run", [(46, 0.8, 19), (46, 1.0, 46), (20, 0.8, 16)])
def test_the_sure_run(least, similar, run):
    assert D.sure_run(least, similar) == run


def test_every_passage_with_the_similarity_shares_a_signature():
    """Several edits in passages of 50 to 300 words, parts in another order too."""
    rng = np.random.default_rng(6)
    tried = 0
    for _ in range(1500):
        near = passage = fresh(rng, int(rng.integers(50, 300)))
        if rng.random() < 0.3:
            cut = int(rng.integers(1, len(near)))
            near = np.concatenate([near[cut:], near[:cut]])
        for _ in range(int(rng.integers(1, 2 + len(passage) // 40))):
            near = edited(rng, near, ("change", "insert", "delete")[rng.integers(0, 3)], int(rng.integers(0, len(near))))
        if min(len(near), len(passage)) < 50 or likeness(tokens(passage), tokens(near)) < SIMILAR:
            continue
        tried += 1
        sides = [tokens(np.concatenate([fresh(rng, 80), p, fresh(rng, 70)])) for p in (passage, near)]
        keys = [D.signatures(t, np.zeros(len(t), np.int64), LEAST, D.HASHES)[0] for t in sides]
        assert len(np.intersect1d(*keys))
    assert tried > 400


def test_hulls_hold_every_range_with_the_similarity():
    """Distinct tokens count, so a hull reaches over repeated tokens that the other text lacks."""
    rng = np.random.default_rng(7)
    for _ in range(200):
        codes = rng.integers(0, 12, 30)
        shared = rng.random(12) < 0.7
        at = np.flatnonzero(shared[codes])
        begin, end = D._Hulls(codes, shared, SIMILAR).around(at)
        for k, place in enumerate(at.tolist()):
            for x in range(place + 1):
                for y in range(place + 1, 31):
                    kinds = np.unique(codes[x:y])
                    if shared[kinds].mean() >= SIMILAR:
                        assert begin[k] <= x and y <= end[k]


def test_texts_that_repeat_the_tokens_the_other_lacks():
    """A title and 60 times a line of 30 words, one word of which differs: 43 of 53 distinct tokens are shared."""
    rng = np.random.default_rng(8)
    title, line = fresh(rng, 17), fresh(rng, 30)
    a, b = (tokens(np.concatenate([title, *[edited(np.random.default_rng(s), line, "change", 5)] * 60])) for s in (1, 2))
    row = np.zeros(len(a), np.int64)
    sides = []
    for text in (a, b):
        key, at, place = D.signatures(text, row, LEAST, 1)
        kept = D.told_apart(text, row, key, at, place, 2 * LEAST)
        assert kept.sum() < len(kept) / 4
        sides += [key[kept], place[kept]]
    got = D.passages(a, b, D.anchors_of(*sides), LEAST, SIMILAR)
    assert got and all(said == likeness(a[x0:x1], b[y0:y1]) >= SIMILAR for x0, x1, y0, y1, said in got)


def test_gains_leave_out_no_pair_of_ranges_with_the_similarity():
    """All pairs of ranges around two places, in short texts of few kinds of tokens."""
    rng = np.random.default_rng(9)
    met = left_out = 0
    for _ in range(150):
        kinds, least = int(rng.integers(4, 14)), 5
        texts = [rng.integers(0, kinds, 12), rng.integers(2, kinds + 2, 12)]
        shared = np.zeros(kinds + 2, bool)
        shared[np.intersect1d(*texts)] = True
        at = np.flatnonzero(shared[texts[0]])
        if not len(at) or not shared[texts[1]].any():
            continue
        p, q = int(at[0]), int(np.flatnonzero(shared[texts[1]])[0])
        gains, ranges = [], []
        for text, place in zip(texts, (p, q), strict=True):
            begin, end = (int(x[0]) for x in D._Hulls(text, shared, SIMILAR).around(np.array([place])))
            gains.append(D._Gains(text, shared, SIMILAR, least).around(place, begin, end))
            ranges.append([set(text[x:y].tolist()) for x in range(place + 1) for y in range(max(place + 1, x + least), 13)])
        best = max((len(a & b) / len(a | b) for a in ranges[0] for b in ranges[1]), default=0)
        if best >= SIMILAR:
            met += 1
            assert D._can_meet(*gains)
        left_out += not D._can_meet(*gains)
    assert met and left_out
