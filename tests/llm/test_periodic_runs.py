"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tapline.llm import periodic_runs as P

SCHEMA = "doc_id bigint, text string, words string, period string, runs int, mark string, g int"


def brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_of(words):
    gone = {i for s, n, q in brute_runs(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def contract_row(doc_id, text):
    words = words_of(text)
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept_of(words).encode()).hexdigest())


def text_with_runs(rng, n):
    words = []
    while len(words) < n:
        block = [rng.choice("abcdefgh") if rng.random() < 0.5 else f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31, 40]))]
        words += block * rng.choice([1, 1, 1, 2, 3, 4, 5, 9]) + block[: rng.randrange(len(block) + 1)]
    return words[:n]


@pytest.mark.parametrize("base", [64, 128, 1 << 13])
def test_tiles_give_the_runs_of_the_whole(base):
    rng = random.Random(base)
    for n in (0, 3, 4, 6, 63, 64, 65, 200, 700, 1500):
        words = text_with_runs(rng, n)
        ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        hashed = P.mix(np.array([ids[w] for w in words], np.uint64) + np.uint64(1))
        pieces = set()
        tiles = list(P.octave_tiles(n, base))
        if tiles:
            bounds = np.concatenate([[0], np.cumsum([t[1] for t in tiles])])
            joined = np.concatenate([hashed[a : a + m] for a, m, _, _ in tiles])
            tile, q, s, e = P.tile_fragments(joined, bounds, np.array([t[2] for t in tiles]), np.array([t[3] for t in tiles]))
            pieces = {(int(p), int(a) + tiles[t][0], int(b) + tiles[t][0]) for t, p, a, b in zip(tile, q, s, e, strict=True)}
        merged = {}
        for p, a, b in sorted(pieces):
            runs = merged.setdefault(p, [])
            if runs and a + p <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        best = {}
        for p, runs in sorted(merged.items()):
            for a, b in runs:
                best.setdefault((a, b), p)
        assert sorted((a, b - a, p) for (a, b), p in best.items()) == brute_runs(words)


def test_every_long_window_lies_in_a_tile_of_its_octave():
    for n in (100, 1000, 5000):
        tiles = list(P.octave_tiles(n, 64))
        for q in (1, 2, 3, 5, 8, 13, 40, 100, n // 4):
            k, need = q.bit_length() - 1, max(6, 4 * q)
            spans = sorted((a, a + m) for a, m, low, high in tiles if low <= k <= high)
            at = 0
            while at + need <= n:
                past = max(b for a, b in spans if a <= at)
                assert at + need <= past
                at = past - need + 1


def rows_for(seed, count=60):
    rng = random.Random(seed)
    rows = [(k * 37 % 1009, rng.choice([" ", "\n", "\t ", "  "]).join(text_with_runs(rng, rng.choice([0, 1, 5, 6, 12, 80, 300, 900])))) for k in range(count)]
    rows += [(2001, None), (2002, ""), (2003, " \n\t "), (2004, "x " * 3000), (2005, "a b " * 7 + "a"), (2006, "Été été " * 9)]
    rows += [rows[3], rows[3], (None, "q q q q q q q"), (None, "q q q q q q q"), (None, None), (3001, "one two " * 8)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", "p", 1, "m", 2) for i, t in rows], SCHEMA)


@pytest.mark.parametrize(("base", "spread"), [(P.TILE_WORDS, P.SPREAD_BYTES), (64, 300)])
def test_query_rows(spark, base, spread):
    rows = rows_for(5)
    found = P.digests(P.collapsed(P.with_repeated_tails(frame(spark, rows)), base, spread))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted((contract_row(i, t) for i, t in rows), key=repr)


def test_empty_table(spark):
    assert P.digests(P.collapsed(P.with_repeated_tails(frame(spark, []).where("false")))).collect() == []


def test_runs_of_a_long_text_come_from_many_tasks(spark):
    """Tiles of one text are dealt over the tasks; a run over all of them is one run."""
    text = "start " + "a b c " * 20_000 + "stop"
    found = P.periodic_runs(frame(spark, [(1, text)]), base=1024, spread=100)
    assert [(r.start, r.length, r.period) for r in found.collect()] == [(1, 60_000, 3)]
    tiles = list(P.octave_tiles(60_002, 1024))
    assert len(tiles) > 100 and max(m for a, m, low, high in tiles if low == 0) == 1024
