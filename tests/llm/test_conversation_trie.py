"""Conversation trie against dictionaries of prefixes."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from tapline.llm import conversation_trie as T
from tapline.llm import queries as Q

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, path string, n int, words int, place int, block int"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    for p, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(cs) - 1) * words
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(rebuilt[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.15:
            continue
        first = rng.choice(["hello there", "hello there", "hello there", "a b c", "", None, "  x\ty "])
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if t else "user", first if t == 0 else rng.choice(["yes", "no", f"word {rng.randrange(6)} more", None])))
    for t in range(150):
        rows.append((1000, t, "user", f"long talk {t}"))
        rows.append((1003, t, "user", f"long talk {t % 140}"))
        rows.append((1024, t, "user" if t < 77 else "bot", f"long talk {t}"))
    rows += [(None, 0, "user", "no id"), (None, None, None, None), (2001, None, "user", "first"), (2001, -5, "user", "second"), (2001, 0, "user", "third"), (2002, 1, "a", "tie"), (2002, 1, "b", "tie"), (2002, 1, "a", "tie"), (2002, 1, "a", "tie")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, 3, 4, 5) for r in rows], SCHEMA)


def built(spark, rows, **options):
    turns, convs = T.with_shared_openings(T.numbered(frame(spark, rows)))
    return sorted((tuple(r) for r in T.prefix_trie(turns, convs, **options).collect()), key=repr)


def test_rows(spark):
    rows = corpus(1)
    assert built(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [2])
def test_many_shards_full_queues_and_short_bands(spark, seed):
    """Shards of few ids and levels, queues of two messages and chunks of a few turns change nothing."""
    rows = corpus(seed)
    assert built(spark, rows, block=8, band=16, queue_messages=2, chunk_rows=7) == brute(rows)


def test_pieces_of_ids_are_hashed_in_order(spark):
    rows = [(c, 0, "user", "same") for c in range(1, 300)]
    turns, convs = T.with_shared_openings(T.numbered(frame(spark, rows)))
    ends = spark.createDataFrame([(1, 7, 8, c) for c in range(-3, 40)] + [(1, 7, 9, 5), (0, 0, 0, 12), (0, 0, 0, 7)], "depth bigint, p1 bigint, p2 bigint, conv_id bigint").repartition(5)
    got = {(r.depth, r.p1, r.p2): r.ends_sha256 for r in T.end_digests(ends, 4).collect()}
    assert got == {(1, 7, 8): hashlib.sha256(",".join(map(str, range(-3, 40))).encode()).hexdigest(), (1, 7, 9): hashlib.sha256(b"5").hexdigest(), (0, 0, 0): hashlib.sha256(b"7,12").hexdigest()}


def test_empty_table(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/conversations.parquet"), reason="needs the tables")
def test_sql_gives_the_rows_of_the_plain_version(spark):
    rows = corpus(4)
    con = duckdb.connect()
    frame_rows = [(c, t, r, x) for c, t, r, x in rows]
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", frame_rows)
    assert sorted(con.execute(Q.ORACLE["op13_conversation_trie"]).fetchall(), key=repr) == brute(rows)
