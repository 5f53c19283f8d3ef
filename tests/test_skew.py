"""One call with most of all rows: same results, work spread over tasks."""

import random

from pyspark.sql import functions as F

from conftest import PACKET
from tapline.operators import messages as messages_module
from tapline.operators import jumps, ordering, sip, streams
from tapline.session import parquet_stage


def hot_rows(n=6000):
    rng = random.Random(5)
    return [
        dict(call_id="hot" if i % 4 else f"c{i % 40}", file_idx=0, frame_number=i + 1, t_rel=i / 50, src_ip="a", src_port=1, dst_ip="b", dst_port=2,
             ssrc=1, seq=rng.randrange(65536), p_type=0, rtcp_pt="")
        for i in range(n)
    ]


def test_hot_key_is_spread_over_tasks(table, spark):
    rows = hot_rows()
    df = table(PACKET, rows).withColumn("_chunk", ordering.chunk_of("frame_number", 250))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordering.with_previous(df, ["call_id"], "_chunk", "frame_number", {"before": "seq"})
        spread = out.where("call_id = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(spread) > 1 and max(r["count"] for r in spread) < 0.8 * sum(r["count"] for r in spread)
    want, last = {}, {}
    for r in rows:
        want[r["frame_number"]] = last.get(r["call_id"])
        last[r["call_id"]] = r["seq"]
    assert {r.frame_number: r.before for r in out.select("frame_number", "before").collect()} == want


def test_running_total_and_dense_index(table):
    df = table(PACKET, hot_rows(900)).withColumn("_chunk", ordering.chunk_of("frame_number", 37)).withColumn("v", F.col("seq") % 5)
    total, want = {}, {}
    for r in hot_rows(900):
        total[r["call_id"]] = total.get(r["call_id"], 0) + r["seq"] % 5
        want[r["frame_number"]] = total[r["call_id"]]
    got = ordering.running_total(df, ["call_id"], "_chunk", "frame_number", "v", "run")
    assert {r.frame_number: r.run for r in got.collect()} == want
    idx = ordering.dense_index(df, ["call_id"], "_chunk", ["frame_number"], "i").orderBy("call_id", "frame_number").collect()
    seen = {}
    for r in idx:
        assert r.i == seen.get(r.call_id, 0)
        seen[r.call_id] = r.i + 1


def test_as_of_join_equals_a_scan(spark):
    rng = random.Random(8)
    left = [(k, i, round(rng.random() * 50, 1)) for i in range(300) for k in ("hot" if rng.random() < 0.7 else "x",)]
    right = [("hot" if rng.random() < 0.7 else "x", round(rng.random() * 50, 1), f"v{i:03d}") for i in range(120)]
    ldf = spark.createDataFrame(left, "k string, i int, t double")
    rdf = spark.createDataFrame(right, "k string, rt double, v string")
    want = {}
    for k, i, t in left:
        hits = [(rt, v) for rk, rt, v in right if rk == k and rt <= t + 0.5]
        want[i] = max(hits)[1] if hits else None
    for bucket in (0.7, 9.0, 1000.0):
        got = ordering.as_of_last(ldf, rdf, ["k"], "t", "rt", ["v"], {"hit": "v"}, tolerance=0.5, bucket_seconds=bucket)
        assert {r.i: r.hit for r in got.collect()} == want


def test_stream_of_a_hot_call(table):
    s = {r.call_id: r for r in streams.rtp_streams(table(PACKET, hot_rows()), 128).collect()}
    assert s["hot"].packet_count == 4500


def greedy_bursts(times, window, least):
    out, i = set(), 0
    while i < len(times):
        last = max(j for j in range(i, len(times)) if times[j] - times[i] <= window)
        if last - i + 1 >= least:
            out |= {(i, j) for j in range(i, last + 1)}
            i = last + 1
        else:
            i += 1
    return out


def test_bursts_of_a_piece_without_pauses(messages, spark):
    """A call whose offers never pause for longer than the window is walked in chunks by many tasks."""
    rng = random.Random(12)
    times = sorted(round(rng.random() * 400, 2) for _ in range(900))
    rows = [dict(what="INVITE", call_id="hot", t_rel=-1.0 + 1.0)] + [dict(what="UPDATE" if k % 3 else "INVITE", call_id="hot", t_rel=t) for k, t in enumerate(times)]
    rows += [dict(what="UPDATE", call_id=f"c{k % 20}", t_rel=float(k)) for k in range(200)]
    m = messages(rows).withColumn("msg_idx", F.col("msg_idx"))
    for window, least, chunk in ((1.5, 3, 16), (1.5, 5, 7), (40.0, 3, 16)):
        got = {(r.burst_idx - 1, r.msg_idx - 1) for r in sip.burst_members(m.where("call_id = 'hot'"), least, window, chunk).collect()}
        assert got == greedy_bursts(times, window, least)
    assert max(b - a for a, b in zip(times, times[1:])) < 5.0


def test_walks_over_jumps(spark):
    """Rows visited from the first one, for jumps of all lengths and chunks smaller and larger than they."""
    rng = random.Random(3)
    rows, want = [], set()
    for key, n in (("hot", 2000), ("a", 1), ("b", 40)):
        to = [min(i + rng.choice([1, 1, 1, 2, 3, 50]), n) for i in range(n)]
        rows += [(key, i, t) for i, t in enumerate(to)]
        at = 0
        while at < n:
            want.add((key, at))
            at = to[at]
    df = spark.createDataFrame(rows, "call_id string, i bigint, to bigint")
    for chunk in (5, 64, 10_000):
        keep = parquet_stage(spark)
        assert {tuple(r) for r in jumps.visited(df, keep, chunk).collect()} == want


def test_messages_without_times_are_ordered_in_many_tasks(table, spark):
    """All rows of one call at one time: splitters are sampled from the rows, so the call is cut into parts."""
    rng = random.Random(4)
    frames = list(range(1, 3001))
    rng.shuffle(frames)
    rows = [dict(call_id="hot", file_idx=f % 2, frame_number=f, t_rel=None if f % 3 else 0.0) for f in frames]
    rows += [dict(call_id=f"c{k}", file_idx=0, frame_number=9000 + k, t_rel=float(-k)) for k in range(50)]
    df = table("call_id string, file_idx int, frame_number bigint, t_rel double", rows).repartition(6)
    keep = parquet_stage(spark)
    got = messages_module.index_messages(df, partitions=8)
    want = {f: i for i, (_, f) in enumerate(sorted((f % 2, f) for f in range(1, 3001)))}
    assert {r.frame_number: r.msg_idx for r in got.where("call_id = 'hot'").collect()} == want
    assert {r.msg_idx for r in got.where("call_id <> 'hot'").collect()} == {0}
    kept = {}
    ordering.range_index(df.withColumn("_t0", F.coalesce("t_rel", F.lit(0.0))), ["call_id"], ["_t0", "file_idx", "frame_number"], "i", lambda n, d: kept.setdefault(n, keep(n, d)), 8)
    parts = kept["i_ranges"].where("call_id = 'hot'").groupBy(F.shiftright("_id", 33).alias("p")).count().collect()
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 1000
