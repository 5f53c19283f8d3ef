"""N-gram Jaccard join against plain sets."""

import random
import re

import numpy as np
import pytest

from tapline.llm import jaccard_join as J

SCHEMA = "doc_id bigint, text string, lang string, n int, sid string, key string"


def sets_of(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                label[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    out = []
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least) for i in members]
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1, "s", "k") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in J.near_duplicates(df).collect()), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.7:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 8, 11, 12, 13, 25, 40, 85, 120, 400, 1500]))]
        rows.append((k * 7 % 61, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (7, "É a b"), (8, "é a b"), (9, "x y z"), (9, "x y z"), (None, None)]
    assert run(spark, rows) == brute_with_blank(rows)
    assert run(spark, []) == []


def brute_with_blank(rows):
    return sorted(((i, n, c if n else i) for (i, n, c) in brute(rows)), key=repr)


def test_tree_finds_all_points_that_can_link():
    rng = np.random.default_rng(5)
    points = rng.poisson(6, (900, J.AXES))
    points[300:600] = np.maximum(points[:300] + rng.integers(-1, 2, (300, J.AXES)) * (rng.random((300, J.AXES)) < 0.2), 0)
    tree = J.CountTree(points, leaf=8)
    sizes = points.sum(axis=1)
    for k in range(0, 900, 30):
        want = np.flatnonzero(J.possible(sizes[k], sizes, np.minimum(points, points[k]).sum(axis=1)))
        assert sorted(tree.search(points[k])) == list(want)


def test_finer_vectors_bound_the_overlap():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (90, 200, 700, 2500)] + [np.arange(0, 1 << 22, 64, dtype=np.uint64)]
    assert [len(J._read_fine(J._fine(s))) for s in sets] == [64, 128, 512, 1024, 2048] and J._read_fine(J._fine(sets[-1])).max() == len(sets[-1]) // 32
    check = J._FineCheck([J._fine(s) for s in sets])
    for s in sets:
        near = set(check.passing(np.arange(len(sets)), J._read_fine(J._fine(s))).tolist())
        assert {k for k, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 90 * len(np.union1d(s, t))} <= near


def test_mixed_groups_are_searched_beyond_the_star(spark, monkeypatch):
    """Chains that the smallest node doesn't link with: a-b and c-d far from the centre, and small blocks."""
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 3)
    base = [f"v{i}" for i in range(300)]
    rng = random.Random(9)
    rows = []
    for c in range(6):
        words = list(base)
        for p in rng.sample(range(300), 14):
            words[p] = f"c{c}x{p}"
        for m in range(4):
            mine = list(words)
            mine[rng.randrange(300)] = f"m{c}{m}"
            rows.append((100 - len(rows), " ".join(mine)))
    assert run(spark, rows) == brute(rows)


def test_one_of_each_keeps_the_smallest_id(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (9, "p q r s"), (2, None), (2, None), (None, "t u v"), (None, "t u v"), (None, "a b c d"), (3, "a b c d")]
    df = spark.createDataFrame([(i, t, "x", 1, "s", "k") for i, t in rows], SCHEMA)
    kept = sorted(((r[0], r[1]) for r in J.one_of_each(df).collect()), key=repr)
    assert kept == sorted([(3, "a b c d"), (9, "p q r s"), (2, None), (2, None), (None, "t u v")], key=repr)


def test_keys_of_several_sets_are_kept(spark):
    """Rows of keys with one set go but for the ends of the parts; repeated rows count once."""
    rng = random.Random(1)
    rows = [(rng.randrange(400), rng.randrange(60)) for _ in range(1500)] + [(7, k) for k in range(500)] + [(9, 1)] * 40
    many = {k for k in range(400) if len({s for key, s in rows if key == k}) > 1}
    want = {(k, s) for k, s in rows if k in many}
    for parts in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = [tuple(r) for r in J.shared_keys(spark.createDataFrame(rows, "key bigint, sid bigint").repartition(3)).collect()]
        assert want <= set(got) and len(set(got) - want) <= 2 * int(parts)
        assert len(got) <= len(set(got)) + int(parts)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
