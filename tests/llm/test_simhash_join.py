"""SimHash classes against plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapline.llm import simhash_join as S

SCHEMA = "doc_id bigint, text string, fingerprint string, n int, part int, value string, a int, b int"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(prints):
    label = list(range(len(prints)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                label[top(i)] = top(j)
    return [top(i) for i in range(len(prints))]


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    of = classes(prints)
    least = {c: min((i for (i, _), d in zip(rows, of, strict=True) if d == c and i is not None), default=None) for c in of}
    return sorted(((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, of, strict=True)), key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Haus", "ÉTÉ", "été"]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.7:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 30, 90, 400]))]
        rows.append((k * 7 % 151, rng.choice([" ", "\n ", "\t"]).join(words)))
    return rows + [(900, None), (None, None), (None, ""), (901, " \n"), (902, "x " * 70_000), rows[5], rows[5], (None, "only here three words"), (903, "only here three words")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, 2, "v", 3, 4) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("parts", [None, 2])
def test_classes_of_texts(spark, parts):
    rows = corpus(3)
    found = S.near_duplicates(frame(spark, rows), parts=parts)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(rows)


def signed(prints):
    return [(int(np.uint64(p).astype(np.int64)),) for p in prints]


@pytest.mark.parametrize(("parts", "crowd"), [(3, 64), (3, 2), (2, 3), (1, 64)])
def test_links_connect_what_is_near(spark, parts, crowd):
    """Random, clustered and lopsided fingerprints; few places for a probe make many crowded."""
    rng = random.Random(parts * 10 + crowd)
    prints = {0, 1, 3, 7, 15, 1 << 63, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64) & (rng.getrandbits(64) | 0xFFFF)
        for _ in range(25):
            p = centre
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    nodes = spark.createDataFrame(signed(prints), "fingerprint bigint")
    pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in S.links(nodes, len(prints), parts, crowd).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    label = {p: p for p in prints}

    def top(p):
        while label[p] != p:
            p = label[p]
        return p

    for a, b in pairs:
        label[top(a)] = top(b)
    mine, theirs = [top(p) for p in prints], classes(prints)
    assert len(set(zip(mine, theirs, strict=True))) == len(set(mine)) == len(set(theirs))


def test_thresholds_follow_the_candidates():
    """A partition whose value is common isn't probed where others are cheaper; the sum is kept."""
    plan = S.Allocation([list(range(22)), list(range(22, 43)), list(range(43, 64))])
    plan.n, shares = 1_000_000, []
    for part in plan.groups:
        shares.append([])
        for g in part:
            share = np.full(1 << len(g), 0.5 / (1 << len(g)))
            if part is plan.groups[0]:
                share[0] = 0.5
            near = [share] + [np.array([share[[v ^ m for m in S._masks(list(range(len(g))), t)[len(S._masks(list(range(len(g))), t - 1)) :]]].sum() for v in range(len(share))]) for t in (1, 2)]
            shares[-1].append(near)
    plan.tables = shares
    chosen = plan.thresholds(np.array([0, (1 << 64) - 1], np.uint64))
    assert ((chosen + 1).sum(axis=1) == 3).all()
    assert chosen[0, 0] == -1 and chosen[1].tolist() == [0, 0, 0]


def test_more_fingerprints_take_fewer_partitions():
    assert [S.parts_for(n) for n in (10, 10**6, 10**9, 10**13)] == [3, 3, 2, 1]


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (5000, 64))
    base[:, 40:56] = base[:, [40]]
    pairs = base.T @ base
    parts = S.partition_bits(pairs, 5000, 3)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any(set(range(40, 56)) <= set(p) for p in parts)


def test_empty_table(spark):
    assert S.near_duplicates(frame(spark, []).where(F.lit(False))).collect() == []


def test_one_class_of_all_rows(spark):
    rows = [(i, "the same words in every row of it") for i in range(3000)] + [(-1, "the same words in every row of it")]
    found = S.near_duplicates(frame(spark, rows))
    assert {r.component_id for r in found.collect()} == {-1}
