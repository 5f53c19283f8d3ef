import random

from pyspark.sql import functions as F

from conftest import MEDIA, PACKET, RS_PARTICIPANT, RS_STREAM, STREAM
from tapline.functions import quality as q
from tapline.operators import binding, detectors, lifecycle, messages as msg, rtcp, scope, ssrc, streams


def packets(table, rows):
    base = {"call_id": "c1", "file_idx": 0, "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "rtcp_pt": "", "rtcp_ids": "", "rtcp_fraction": "", "rtcp_cumulative": "", "rtcp_jitter": ""}
    return table(PACKET, [{"frame_number": i + 1, **r} for i, r in enumerate(rows)], **base)


def test_gaps_and_mux_guard(table):
    p = packets(table, [
        dict(t_rel=1.0, src_port=41134, dst_port=37874, ssrc=0x6F231F4B, seq=5, p_type=0),
        dict(t_rel=1.02, src_port=41134, dst_port=37874, ssrc=0x6F231F4B, seq=8, p_type=0),
        dict(t_rel=5.0, src_port=15298, dst_port=33704, ssrc=0x83B569DA, seq=1, p_type=72),
    ])
    (s,) = streams.index_streams(streams.rtp_streams(p)).collect()
    assert (s.packet_count, s.sequence_gaps, s.largest_gap, s.ssrc) == (2, 1, 2, 0x6F231F4B)
    assert streams.rtcp_on_media_count(p).first().rtcp_on_media_ports == 1


def test_rtcp_presence_and_wraparound(table):
    p = packets(table, [dict(t_rel=float(i), src_port=30000, dst_port=40000, ssrc=7, seq=n, p_type=0) for i, n in enumerate((65534, 65535, 0, 1))]
                + [dict(t_rel=2.5, dst_port=40001, rtcp_pt="200")])
    st = streams.mark_rtcp_observed(streams.index_streams(streams.rtp_streams(p)), streams.rtcp_targets(p)).first()
    assert (st.sequence_gaps, st.largest_gap, st.rtcp_observed, st.first_seq, st.last_seq) == (0, 0, True, 65534, 1)


def test_streams_equal_plain_loop_for_any_chunk_size(table):
    rng = random.Random(1)
    rows = [
        dict(call_id=f"c{rng.randrange(3)}", file_idx=rng.randrange(2), frame_number=i + 1, t_rel=rng.choice([None, rng.random() * 9]), src_port=rng.randrange(3),
             dst_port=rng.choice([5, 6, None]), ssrc=rng.choice([1, 2, None]), seq=rng.choice([None, rng.randrange(65536)]), p_type=rng.choice([0, 8, 70]))
        for i in range(600)
    ]
    want = {}
    for r in sorted(rows, key=lambda r: (r["file_idx"], r["frame_number"])):
        if 64 <= r["p_type"] <= 95:
            continue
        s = want.setdefault((r["call_id"], r["ssrc"], r["dst_port"]), dict(n=0, pt=r["p_type"], sp=r["src_port"], t=[], q=[]))
        s["n"] += 1
        s["t"] += [r["t_rel"]] if r["t_rel"] is not None else []
        s["q"] += [r["seq"]] if r["seq"] is not None else []
    for chunk in (1, 7, 1 << 18):
        got = streams.rtp_streams(packets(table, rows), chunk).collect()
        assert len(got) == len(want)
        for g in got:
            w = want[(g.call_id, g.ssrc, g.dst_port)]
            deltas = [(b - a) & 0xFFFF for a, b in zip(w["q"], w["q"][1:])]
            assert (g.packet_count, g.payload_type, g.src_port, g.first_t, g.last_t) == (w["n"], w["pt"], w["sp"], w["t"][0] if w["t"] else None, w["t"][-1] if w["t"] else None)
            assert (g.sequence_gaps, g.largest_gap) == (sum(d > 1 for d in deltas), max([d - 1 for d in deltas if d > 1], default=0))


def test_ssrc_change(table):
    def p(sp, t, s):
        return dict(t_rel=t, src_port=sp, dst_port=9, ssrc=s)

    rows = packets(table, [p(1, 0.1, 0x111), p(2, 0.5, 0x999), p(1, 1.0, 0x111), p(1, 5.0, 0x222)])
    for chunk in (1, 1000):
        (c,) = ssrc.ssrc_changes(ssrc.ssrc_observations(rows), chunk).collect()
        assert (c.from_ssrc, c.to_ssrc, c.t_rel) == (0x111, 0x222, 5.0)


def test_rtcp_stats_and_findings(table):
    p = packets(table, [
        dict(t_rel=1.0, rtcp_pt="201", rtcp_ids="100", rtcp_fraction="26", rtcp_cumulative="5", rtcp_jitter="10"),
        dict(t_rel=20.0, rtcp_pt="201", rtcp_ids="100", rtcp_fraction="13", rtcp_cumulative="9", rtcp_jitter="30"),
        dict(t_rel=21.0, rtcp_pt="203", rtcp_ids="100"),
    ])
    for bucket in (1.0, 600.0):
        s = rtcp.rtcp_stats(p, bucket).first()
        assert s.rtcp_bye_seen and s.fraction_lost_max > 0.1 and s.max_report_gap_s == 19.0 and s.cumulative_lost == 9 and s.jitter_avg == 20.0 and s.report_count == 3
    codes = {r.code for d in detectors.detect_rtcp_quality(rtcp.rtcp_stats(p)) for r in d.collect()}
    assert codes == {"RTCP_HIGH_LOSS", "RTCP_TIMEOUT", "RTCP_BYE"}


def test_rtcp_compound_and_mux(table):
    p = packets(table, [dict(rtcp_pt="200"), dict(rtcp_pt="200,202", rtcp_ids="0x5")])
    s = rtcp.rtcp_summary(p).first()
    assert (s.total, s.sr, s.sdes, s.report_blocks) == (2, 2, 1, 0)
    assert detectors.detect_rtcp_presence(rtcp.rtcp_summary(p)).first().code == "RTCP_NO_REPORTS"
    s = rtcp.rtcp_summary(packets(table, [dict(p_type=72), dict(p_type=73)])).first()
    assert (s.muxed_as_rtp, s.sr, s.rr) == (2, 1, 1)


def test_media_port_rtcp_counts_only_without_native_reports(table):
    p = packets(table, [
        dict(call_id="a", rtcp_pt="201", rtcp_ids="5", rtcp_fraction="1", rtcp_jitter="2"), dict(call_id="a", p_type=72),
        dict(call_id="b", rtcp_pt="200"), dict(call_id="b", p_type=72), dict(call_id="c", p_type=73),
    ])
    got = sorted((r.call_id, r.rtcp_pt, r.p_type) for r in rtcp.chosen_rows(p).fillna(0).collect())
    assert got == [("a", "201", 0), ("b", "", 72), ("b", "200", 0), ("c", "", 73)]


def test_two_blocks_in_one_row(table):
    p = packets(table, [dict(t_rel=1.0, rtcp_pt="201", rtcp_ids="0xAAAA,0xBBBB", rtcp_fraction="0,5", rtcp_jitter="2,40")])
    blocks = {b.ssrc: b for b in rtcp.report_blocks(p).collect()}
    assert len(blocks) == 2 and blocks[0xBBBB].fraction == 5
    assert {s.ssrc: s.fraction_lost_max for s in rtcp.rtcp_stats(p).collect()}[0xBBBB] == 5 / 256


def stream_rows(table, rows):
    return table(STREAM, [{"stream_idx": i, **r} for i, r in enumerate(rows)], call_id="c1", src_ip="10.0.0.1", dst_ip="10.0.0.2", packet_count=5000, sequence_gaps=0, largest_gap=0, rtcp_observed=True)


def test_mos_trend_clock_and_findings(table, spark):
    def estimate(pt, rows):
        p = packets(table, [dict(t_rel=t, rtcp_pt="201", rtcp_ids="7", rtcp_fraction=str(f), rtcp_jitter=str(j)) for t, f, j in rows])
        samples = rtcp.mos_samples(p, stream_rows(table, [dict(ssrc=7, payload_type=pt)]))
        return samples.orderBy("t_rel").collect(), rtcp.mos_estimates(samples)

    samples, est = estimate(0, [(1.0, 0, 40), (250.0, 60, 800)])
    e = est.first()
    assert e.codec.startswith("PCMU") and samples[0].mos > 4.0 and e.mos_min < 2.6 and samples[1].jitter_ms == 100.0
    samples, est = estimate(9, [(1.0, 0, 800)])
    assert samples[0].jitter_ms == 50.0 and est.first().codec == "G.722"
    bad = detectors.detect_mos(estimate(0, [(1.0, 80, 1200)])[1]).first()
    assert (bad.severity, bad.code) == ("ERROR", "MOS_BAD")
    assert detectors.detect_mos(estimate(0, [(1.0, 0, 40)])[1]).count() == 0
    losses = spark.createDataFrame([(float(i),) for i in range(0, 60, 5)], "l double")
    mos = [r[0] for r in losses.select(q.r_to_mos(q.r_factor(F.col("l"), F.lit(30.0), F.lit(0.0), F.lit(25.1)))).collect()]
    assert mos == sorted(mos, reverse=True) and mos[0] > 4.3


def test_label_binding(table):
    st = stream_rows(table, [
        dict(ssrc=1, src_port=41134, dst_port=37874), dict(ssrc=2, src_port=41134, dst_port=37874), dict(ssrc=3, src_port=15298, dst_port=33704),
    ]).drop("matched_sdp_label", "matched_siprec_stream_id", "participant_aor", "participant_name")
    md = table(MEDIA, [dict(msg_idx=0, media_idx=0, port=15298, label="446"), dict(msg_idx=0, media_idx=1, port=41134, label="447")], call_id="c1", media_type="audio")
    rs = table(RS_STREAM, [dict(ord=0, stream_id="S1", label="446", participant_ids=["P1"]), dict(ord=1, stream_id="S2", label="447", participant_ids=["P2", "P3"])], call_id="c1", msg_idx=0)
    rp = table(RS_PARTICIPANT, [dict(ord=0, participant_id="P1", name="FLORIDA"), dict(ord=1, participant_id="P2", name="AGENT", aor="sip:87@cc")], call_id="c1", msg_idx=0)
    b = binding.bind_labels(binding.match_by_dst_port(st, md, rs), md, rs, rp)
    got = {r.ssrc: (r.matched_sdp_label, r.matched_siprec_stream_id, r.participant_name) for r in b.collect()}
    assert got == {1: ("447", "S2", "AGENT"), 2: ("447", "S2", "AGENT"), 3: ("446", "S1", "FLORIDA")}
    assert binding.distinct_media_count(b).first()[:] == ("c1", 2, 3)
    assert {r.label: r.participant for r in binding.participant_labels(b).collect()} == {"446": "FLORIDA", "447": "AGENT (87)"}


def test_positional_fallback(table):
    st = stream_rows(table, [dict(ssrc=1, src_port=1, dst_port=2)]).drop("matched_sdp_label", "matched_siprec_stream_id", "participant_aor", "participant_name")
    md = table(MEDIA, [dict(msg_idx=0, media_idx=0, port=9, label="x")], call_id="c1")
    rs = table(RS_STREAM, [dict(ord=0, stream_id="ONLY")], call_id="c1", msg_idx=0)
    assert binding.positional_fallback(binding.match_by_dst_port(st, md, rs), rs).first().matched_siprec_stream_id == "ONLY"
    two = table(RS_STREAM, [dict(ord=0, stream_id="A"), dict(ord=1, stream_id="B")], call_id="c1", msg_idx=0)
    assert binding.positional_fallback(binding.match_by_dst_port(st, md, two), two).first().matched_siprec_stream_id is None


def test_coverage_gap_and_lifecycle(table, messages):
    from conftest import media

    st = stream_rows(table, [
        dict(ssrc=0x6F231F4B, first_t=128.0, last_t=244.0, packet_count=7314, matched_sdp_label="447", participant_name="AGENT", participant_aor="sip:87@cc", src_port=1, dst_port=2),
        dict(ssrc=0x8D476707, first_t=244.3, last_t=364.0, packet_count=5822, matched_sdp_label="447", participant_name="AGENT", participant_aor="sip:87@cc", src_port=1, dst_port=2),
        dict(ssrc=5, first_t=200.0, last_t=201.0, packet_count=3, matched_sdp_label="447", src_port=1, dst_port=2),
    ])
    m = messages([
        dict(what="INVITE", t_rel=0.0, media=[media()]), dict(what="INVITE", t_rel=243.9, media=[media("inactive")], cseq="727 INVITE"),
        dict(what="INVITE", t_rel=244.2, media=[media()], cseq="728 INVITE"),
    ])
    from tapline.operators import timeline

    holds = timeline.hold_retrieve_events(m)
    assert [(h.kind, h.t_rel) for h in holds.orderBy("msg_idx").collect()] == [("HOLD", 243.9), ("RETRIEVE", 244.2)]
    for bucket in (10.0, 600.0):
        segs = lifecycle.lifecycle_segments(st, m, bucket_seconds=bucket)
        lc = lifecycle.label_lifecycles(st, segs)
        row = lc.first()
        assert (row.n_segments, row.ssrc_change_count, row.noise_stream_count, row.participant) == (2, 1, 1, "AGENT (87)")
        assert {r.ssrc: r.trigger_cseq for r in segs.collect()} == {0x6F231F4B: None, 0x8D476707: "728 INVITE"}
        (g,) = lifecycle.coverage_gaps(segs, holds, lc).collect()
        assert (g.old_ssrc, g.new_ssrc) == (0x6F231F4B, 0x8D476707) and abs(g.duration_s - 119.7) < 1e-6
    gap = detectors.detect_lifecycle(lifecycle.coverage_gaps(segs, holds, lc), lifecycle.ssrc_collisions(segs, lc), lc, segs)[0].first()
    assert (gap.severity, gap.code, gap.owner) == ("CRITICAL", "SIPREC-001", "SBC") and "0x6f231f4b" in gap.detail and "120s" in gap.detail


def test_collisions_equal_all_pairs(table, messages):
    rng = random.Random(3)
    rows = []
    for c in range(20):
        for i in range(15):
            t = round(rng.random() * 200, 1)
            rows.append(dict(call_id=f"c{c}", stream_idx=i, ssrc=rng.randrange(4), first_t=t, last_t=round(t + rng.random() * 80, 1), packet_count=rng.choice([1, 200]),
                             matched_sdp_label=rng.choice("ab"), src_port=1, dst_port=2))
    st = stream_rows(table, rows)
    m = messages([dict(what="INVITE", call_id=f"c{c}") for c in range(20)])
    segs = lifecycle.lifecycle_segments(st, m, min_packets=1)
    lc = lifecycle.label_lifecycles(st, segs, 1)
    want = set()
    for a in rows:
        for b in rows:
            if a["call_id"] == b["call_id"] and a["matched_sdp_label"] == b["matched_sdp_label"] and (a["first_t"], a["stream_idx"]) < (b["first_t"], b["stream_idx"]):
                if a["ssrc"] != b["ssrc"] and a["packet_count"] > 1 and b["packet_count"] > 1 and min(a["last_t"], b["last_t"]) >= max(a["first_t"], b["first_t"]):
                    want.add((a["call_id"], a["stream_idx"], b["stream_idx"]))
    for bucket in (7.0, 1000.0):
        got = lifecycle.ssrc_collisions(segs, lc, bucket).select("call_id", "idx_a", "idx_b").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_media_scoping_counts_a_packet_once(table):
    ports = table("call_id string, port int", [dict(call_id="a", port=10), dict(call_id="a", port=20), dict(call_id="b", port=20)])
    p = packets(table, [dict(src_port=10, dst_port=20), dict(src_port=20, dst_port=99), dict(src_port=1, dst_port=2), dict(src_port=10, dst_port=10)]).drop("call_id")
    got = sorted((r.call_id, r.frame_number) for r in scope.scope_media_to_calls(p, ports).collect())
    assert got == [("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 2)]
    files = table("call_id string, file_idx int", [dict(call_id="n", file_idx=0)])
    assert scope.scope_media_to_calls(p, ports, call_files=files).where("call_id = 'n'").count() == 4


def test_time_bound_scoping_keeps_untimed_packets_and_calls(table):
    ports = table("call_id string, port int", [dict(call_id="a", port=10), dict(call_id="b", port=10), dict(call_id="u", port=10)])
    spans = table("call_id string, start_epoch double, end_epoch double", [dict(call_id="a", start_epoch=1000.0, end_epoch=2000.0), dict(call_id="b", start_epoch=90000.0, end_epoch=99000.0), dict(call_id="u")])
    p = packets(table, [dict(src_port=10, dst_port=1, ts_epoch=1500.0), dict(src_port=1, dst_port=10, ts_epoch=95000.0), dict(src_port=10, dst_port=10), dict(src_port=10, dst_port=2, ts_epoch=50000.0)]).drop("call_id")
    got = sorted((r.call_id, r.frame_number) for r in scope.scope_media_to_calls(p, ports, spans).collect())
    assert got == [("a", 1), ("a", 3), ("b", 2), ("b", 3), ("u", 1), ("u", 2), ("u", 3), ("u", 4)]
    files = table("call_id string, file_idx int", [dict(call_id="b", file_idx=0)])
    none = ports.where("call_id = 'u'")
    got = sorted(r.frame_number for r in scope.scope_media_to_calls(p, none, spans, files).where("call_id = 'b'").collect())
    assert got == [2, 3]


def test_long_spans_cost_few_rows_and_meet_only_what_they_hold(table, spark):
    """Spans of seconds to millennia on one port: a span lies in 17 slots at most, and all pairs are found."""
    rng = random.Random(6)
    spans = [("s%d" % k, 1.7e9 + rng.random() * 10.0 ** rng.randrange(3, 9), 10.0 ** rng.randrange(0, 10)) for k in range(60)] + [("wrong", 0.0, 4e11), ("edge", 1.7e9, 0.0)]
    spans = [(c, a, a + n) for c, a, n in spans]
    windows = spark.createDataFrame(spans, "call_id string, _from double, _to double")
    cost = {r.call_id: r["count"] for r in scope._laid_out(windows).groupBy("call_id").count().collect()}
    assert len(cost) == len(spans) and max(cost.values()) <= 17
    times = [1.7e9] + [1.7e9 + rng.random() * 10.0 ** rng.randrange(2, 11) for _ in range(200)]
    p = packets(table, [dict(src_port=10, dst_port=20, ts_epoch=t) for t in times]).drop("call_id")
    ports = table("call_id string, port int", [dict(call_id=c, port=10) for c, _, _ in spans])
    known = table("call_id string, start_epoch double, end_epoch double", [dict(call_id=c, start_epoch=a, end_epoch=b) for c, a, b in spans])
    got = sorted((r.call_id, r.ts_epoch) for r in scope.scope_media_to_calls(p, ports, known, slack_seconds=0.0).collect())
    assert got == sorted((c, t) for c, a, b in spans for t in times if a <= t <= b)
    files = table("call_id string, file_idx int", [dict(call_id=c, file_idx=0) for c, _, _ in spans])
    none = table("call_id string, port int", [])
    got = sorted((r.call_id, r.ts_epoch) for r in scope.scope_media_to_calls(p, none, known, files, slack_seconds=0.0).collect())
    assert got == sorted((c, t) for c, a, b in spans for t in times if a <= t <= b)


def test_slots_keep_a_reused_port_apart(table, spark):
    """Many calls use one port one after the other: what meets in slots is bounded by what overlaps."""
    n = 400
    windows = spark.createDataFrame([("c%d" % k, 7200.0 * k, 7200.0 * k + 7000.0, 10) for k in range(n)], "call_id string, _from double, _to double, port int")
    p = spark.createDataFrame([(10, 7200.0 * n * i / 3000) for i in range(3000)], "port int, ts_epoch double")
    plan = scope._met(p, windows, ["port"])
    laid = scope._laid_out(windows)
    met = p.withColumn("_slot", F.floor(F.col("ts_epoch") / 3600).cast("bigint")).join(laid.where("_level = 0"), ["port", "_slot"]).count()
    assert 2900 < plan.count() <= met <= 2 * 3000
    assert laid.groupBy("_level").count().collect()[0][0] == 0


def test_hold_suppresses_gap_findings(table):
    st = stream_rows(table, [dict(ssrc=1, first_t=6.0, last_t=8.0, sequence_gaps=4, largest_gap=9, rtcp_observed=False)])
    counts = table("call_id string, declared bigint, observed bigint, distinct_media bigint, sdp_count bigint", [dict(call_id="c1", declared=1, observed=1, distinct_media=1, sdp_count=1)])
    scal = table("call_id string, established_at double, terminated_at double", [dict(call_id="c1")])

    def codes(*windows):
        hw = table("call_id string, msg_idx bigint, hold_start double, hold_end double", [dict(call_id="c1", msg_idx=i, hold_start=a, hold_end=b) for i, (a, b) in enumerate(windows)])
        return {r.code for d in detectors.detect_gaps(st, counts, scal, hw) for r in d.collect()}

    assert codes((5.0, 9.0)) == set() and codes((5.0, None)) == set()
    assert codes((1.0, 2.0)) == {"RTP_SEQ_GAP", "RTP_MISSING_RTCP"} and codes((7.0, 9.0)) == {"RTP_SEQ_GAP", "RTP_MISSING_RTCP"}


def test_scoped_counts_equal_the_scoped_rows(spark, table):
    """Frame numbers that are null, doubled under one pair of ports, under several and in several files."""
    rng = random.Random(5)
    rows = [
        dict(file_idx=rng.choice([0, 1, 2, None]), frame_number=rng.choice([None, *range(40)]), src_port=rng.choice([None, 10, 12, 20]), dst_port=rng.choice([None, 10, 13, 30]),
             rtcp_pt=rng.choice(["", "200", None]))
        for _ in range(400)
    ]
    p = packets(table, rows).drop("call_id")
    ports = spark.createDataFrame([("a", 10), ("a", 12), ("b", 13), ("b", 30), ("c", 99)], "call_id string, port int")
    of_files = spark.createDataFrame([("d", 0), ("d", 1), ("e", 2), ("f", None), ("g", 7), (None, 0)], "call_id string, file_idx int")
    for files in (None, of_files):
        want = scope.scope_media_to_calls(p, ports, None, files).groupBy("call_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("frame_number").alias("frames"), F.count_if(scope.is_rtcp()).alias("rtcp")
        )
        counts = scope.scoped_counts(p, ports, files)
        assert set(map(tuple, counts.collect())) == set(map(tuple, want.collect())) and counts.count() == want.count()
        assert {r.call_id for r in want.collect()} == ({"a", "b"} if files is None else {"a", "b", "d", "e", None})


def test_packets_of_one_file_are_dealt_over_tasks(spark, table):
    p = packets(table, [dict(src_port=1, dst_port=2) for _ in range(2000)]).drop("call_id")
    ports = spark.createDataFrame([], "call_id string, port int")
    calls = spark.createDataFrame([(f"c{i}", 0) for i in range(40)], "call_id string, file_idx int")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = scope.scope_media_to_calls(p, ports, None, calls).select("call_id", "frame_number", F.spark_partition_id().alias("part"))
        sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum(sizes) == 2000 * 40 and max(sizes) < 2000 * 40 / 8


def test_messages_without_a_call_id_keep_the_packets_of_their_file(spark, table):
    p = packets(table, [dict(src_port=1, dst_port=2) for _ in range(3)]).drop("call_id")
    calls = spark.createDataFrame([(None, 0), ("a", 0)], "call_id string, file_idx int")
    ports = spark.createDataFrame([], "call_id string, port int")
    rows = scope.scope_media_to_calls(p, ports, None, calls).collect()
    assert sorted((r.call_id or "", r.frame_number) for r in rows) == [(c, n) for c in ("", "a") for n in (1, 2, 3)]


def test_packets_of_a_file_named_by_a_constant_are_dealt_over_tasks(spark):
    """The file's number is a constant, bytes are few and tasks are merged by size: still many tasks, one shuffle of the packets."""
    p = spark.range(1, 3001).selectExpr("0 as file_idx", "id as frame_number", "1 as src_port", "2 as dst_port", "cast(id as double) as ts_epoch")
    ports = spark.createDataFrame([], "call_id string, port int")
    calls = spark.createDataFrame([(f"c{i}", 0) for i in range(40)] + [(None, 0), ("x", None), ("y", 1)], "call_id string, file_idx int")
    rows = scope.scope_media_to_calls(p, ports, None, calls)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sum(sizes) == 3000 * 41 and len(sizes) > 32 and max(sizes) < 3000 * 41 / 12
    assert rows.where("call_id is null").count() == 3000 and rows.where("call_id in ('x', 'y')").count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(0" not in plan


def test_packets_without_frames_or_times_are_dealt_too(spark, table):
    """Files that are null meet nothing; packets without a frame are told apart by what they have."""
    rows = [dict(file_idx=i % 3 or None, frame_number=None, ts_epoch=None, seq=i, src_port=1, dst_port=2) for i in range(300)]
    p = packets(table, rows).drop("call_id")
    calls = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1), ("n", None)], "call_id string, file_idx int")
    found = scope.scope_media_to_calls(p, spark.createDataFrame([], "call_id string, port int"), None, calls).groupBy("call_id").count().collect()
    assert {r[0]: r[1] for r in found} == {"a": 100, "b": 200}


def test_focused_packets_of_one_file_are_dealt_over_tasks(spark, messages):
    """Signalling in one message, media of a file whose number is a constant: many tasks, every packet once a call."""
    m = messages([dict(what="INVITE", call_id=f"c{i}") for i in range(30)])
    p = spark.range(1, 2001).selectExpr(
        "0 as file_idx", "id as frame_number", "cast(id as double) as ts_epoch", "'10.0.0.1' as src_ip", "1 as src_port", "'10.0.0.2' as dst_ip", "2 as dst_port",
        "case when id % 4 = 0 then '200' else '' end as rtcp_pt",
    )
    ports = scope.call_ports(msg.sdp_media(m))
    rows = scope.focused_packets(m, scope.scope_media_to_calls(p, ports, None, scope.calls_without_ports(m, ports)))
    found = rows.groupBy(F.spark_partition_id().alias("part"), "kind").count().collect()
    assert {k: sum(r["count"] for r in found if r.kind == k) for k in ("sip", "rtp", "rtcp")} == {"sip": 30, "rtp": 45_000, "rtcp": 15_000}
    assert max(r["count"] for r in found) < 60_000 / 12 and len({r.part for r in found}) > 32
