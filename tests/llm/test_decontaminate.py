"""Suffix automaton against plain window searches."""

import hashlib
import random
import tracemalloc

import pytest

from tapline.llm import decontaminate as D

SCHEMA = "doc_id bigint, text string, runs string, items int, n_words string"
ITEMS = "item_id bigint, text string, doc_id int"


def brute(words, items, window):
    hit, found = [False] * len(words), set()
    for name, own in items:
        for w in [own] if len(own) < window else [own[k : k + window] for k in range(len(own) - window + 1)]:
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    found.add(str(name))
                    hit[p : p + len(w)] = [True] * len(w)
    return sum(hit), found


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_automaton_equals_windows(window):
    rng = random.Random(window)
    for _ in range(400):
        letters = "abc"[: rng.choice([1, 2, 3])]
        items = [(i, [rng.choice(letters) for _ in range(rng.randint(1, 9))]) for i in range(rng.randint(0, 4))]
        words = [rng.choice(letters + "z") for _ in range(rng.randint(0, 25))]
        runs, found = D.Automaton(items, window).scan(words)
        assert (sum(b - a for a, b in runs), {str(items[k][0]) for k in found}) == brute(words, items, window)
        assert all(a < b for a, b in runs) and all(x[1] < y[0] or x[1] <= y[0] for x, y in zip(runs, runs[1:], strict=False))


def documents():
    rng = random.Random(9)
    items = [(i, [rng.choice("abcdefgh") for _ in range(rng.choice([3, 10, 14, 25]))]) for i in range(12)]
    rows = []
    for k in range(40):
        words = [rng.choice("stuvwxyz") for _ in range(rng.randint(0, 30))]
        if k % 3 == 0:
            own = rng.choice(items)[1]
            words[5:5] = own[: rng.randint(3, len(own))]
        rows.append((k, ", ".join(w.upper() if rng.random() < 0.3 else w for w in words)))
    return rows + [(None, None), (7, ""), (7, ""), (8, "É-é é"), (9, " ".join(items[3][1]))], items + [(50, []), (51, ["é", "é"])]


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_rows_equal_brute_force(spark, block):
    rows, items = documents()
    docs = spark.createDataFrame([(i, t, "r", 1, "n") for i, t in rows], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items] + [(52, None, 1)], ITEMS)
    want = []
    for i, t in rows:
        words = D.words_of(t)
        n, found = brute(words, [x for x in items if x[1]], 10)
        want.append((i, len(words), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0))
    assert sorted(map(tuple, D.contamination(docs, bench, block_words=block).collect()), key=repr) == sorted(want, key=repr)


def test_words():
    assert D.words_of("Ab-C9 'É_é\x7f1 z") == ["ab", "c9", "É", "é", "1 z"] and D.words_of(None) == []


def plainly_cut(text, items):
    """Cut all that is hit again and again; None if more than half is hit at first."""
    first = True
    while True:
        spans = [m.span() for m in D._WORD.finditer(D.lowered(text))]
        words = [D.lowered(text)[a:b] for a, b in spans]
        hit = [False] * len(words)
        for _, item in items:
            for k in range(max(len(item) - 9, 1)):
                part = item[k : k + 10]
                for at in range(len(words) - len(part) + 1):
                    if words[at : at + len(part)] == part:
                        hit[at : at + len(part)] = [True] * len(part)
        if not any(hit):
            return text
        if first and sum(hit) > 0.5 * len(words):
            return None
        first, out, at, k = False, [], 0, 0
        while k < len(words):
            if hit[k]:
                end = k
                while end < len(words) and hit[end]:
                    end += 1
                out.append(text[at : spans[k][0]])
                at, k = spans[end - 1][1], end
            k += 1
        text = "\n".join([*out, text[at:]])


@pytest.mark.parametrize("block", [1_000_000, 20, 1])
def test_blocks_of_any_size_cut_the_same(spark, block):
    """Coverage spread over items of different blocks counts together, and what a cut joins is cut too."""
    rows, items = documents()
    a, b = ([f"{x}{k}" for k in range(12)] for x in "ab")
    split = [" ".join(a[:6]), " ".join(b), " ".join(a[6:])]
    rows = rows + [(100, " ".join([*a, *(f"x{k}" for k in range(16)), *b])), (101, " ".join([*a, *(f"x{k}" for k in range(30)), *b])), (102, " ".join([*(f"x{k}" for k in range(40)), *split, "end"]))]
    items = items + [(60, a), (61, b), (None, [f"n{k}" for k in range(11)])]
    docs = spark.createDataFrame([(i, t, "r", 1, "n") for i, t in rows], SCHEMA)
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items], ITEMS)
    out = D.decontaminate(docs, bench, block_words=block)
    assert out.columns == docs.columns
    filled = [x for x in items if x[1]]
    want = [(i, t if t is None else plainly_cut(t, filled)) for i, t in rows]
    want = [(i, n) for (i, n), (_, t) in zip(want, rows, strict=True) if t is None or n is not None]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert 100 not in {i for i, _ in want} and {101, 102} <= {i for i, _ in want}


def test_a_long_item_is_matched_in_pieces(spark):
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(k, " ".join(words[k : k + 10]), "r", 1, "n") for k in range(0, 291)], SCHEMA)
    bench = spark.createDataFrame([(5, " ".join(words), 1)], ITEMS)
    found = D.contamination(docs, bench, block_words=25).collect()
    assert all((r["n_hit"], r["n_items"]) == (10, 1) for r in found)


def test_an_automaton_at_its_bound_fits_a_worker():
    tracemalloc.start()
    rng = random.Random(2)
    D.Automaton([(k, [f"w{rng.randrange(30_000)}" for _ in range(200)]) for k in range(D.BLOCK_WORDS // 200)])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 300e6


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    assert D.contamination(docs, bench).collect() == []
    one = spark.createDataFrame([(1, "a b", "r", 1, "n")], SCHEMA)
    assert tuple(D.contamination(one, bench).first())[:4] == (1, 2, 0, 0)
    assert D.decontaminate(one, bench).count() == 1
