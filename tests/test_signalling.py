import random

import pytest
from pyspark.sql import functions as F

from conftest import RS_PARTICIPANT, RS_STREAM, SNAPSHOT, STREAM, media
from tapline.operators import baseline, batch, detectors, findings as fd, health, identity, messages as msg, report, sip, timeline

PCMU, PCMA = ("0",), ("8",)


def test_burst_with_codec_change(messages):
    m = messages([
        dict(what="INVITE", t_rel=0.0), dict(what=200, t_rel=0.2), dict(what="INVITE", t_rel=8.0, media=[media(payloads=PCMU)]),
        dict(what="INVITE", t_rel=8.7, media=[media(payloads=PCMA)]), dict(what="INVITE", t_rel=9.4, media=[media(payloads=PCMU)]),
    ])
    members = sip.burst_members(m)
    (b,) = sip.bursts(members).collect()
    assert (b["count"], b.codec_renegotiation, b.window_start) == (3, True, 8.0)
    found = detectors.detect_bursts(members)
    f = found.first()
    frames = fd.evidence_table(found, [fd.evidence_rows(members, 80, F.col("burst_idx"))]).orderBy("pos").collect()
    assert [r.frame_number for r in frames] == [3, 4, 5] and f.evidence_count == 3 and "within 1.4s" in f.detail
    assert sip.burst_members(messages([dict(what="INVITE", t_rel=t) for t in (0.0, 60.0, 120.0)])).count() == 0


def test_long_evidence_loses_no_frame(messages):
    m = messages([dict(what="INVITE", t_rel=0.0)] + [dict(what="INVITE", t_rel=8.0 + i / 1000) for i in range(5000)])
    members = sip.burst_members(m)
    found = detectors.detect_bursts(members)
    rows = fd.evidence_table(found, [fd.evidence_rows(members, 80, F.col("burst_idx"))])
    assert found.first().evidence_count == 5000
    assert [r.frame_number for r in rows.orderBy("pos").collect()] == list(range(2, 5002))
    assert found.columns == list(fd.COLUMNS)


def test_places_of_many_streams_keep_their_order(spark):
    places = [(131, (64, 0, 1)), (131, (64, 5, 2)), (131, (3_000_000, 1, 4_000_000)), (132, (0,)), (130, (70, 1 << 33))]
    df = spark.createDataFrame([(o, list(s)) for o, s in places], "ord int, sub array<bigint>")
    got = [(r.ord, tuple(r.sub)) for r in df.orderBy(report._place()).collect()]
    assert got == sorted(places)


def random_calls(rng, n=60):
    specs = []
    for c in range(n):
        t = 0.0
        for _ in range(rng.randrange(0, 30)):
            t = round(t + rng.choice([0.0, 0.5, 1.5, 3.0, 9.0]), 1)
            what = rng.choice(["INVITE", "INVITE", "UPDATE", "ACK", "BYE", 180, 200])
            lines = None if isinstance(what, int) or rng.random() < 0.2 else [
                media(rng.choice(["inactive", "inactive", "sendonly", "sendrecv", None]), payloads=rng.choice([PCMU, PCMA])) for _ in range(rng.choice([1, 2]))
            ]
            specs.append(dict(what=what, call_id=f"c{c}", t_rel=None if rng.random() < 0.1 and t == 0 else t, media=lines))
    return specs


def by_call(specs):
    out: dict[str, list] = {}
    for s in specs:
        out.setdefault(s["call_id"], []).append(s)
    return out


def line_directions(s):
    return [m[6] for m in s["media"] or [] if m[6]]


@pytest.mark.parametrize("chunk", [1, 3, 1 << 18])
def test_state_machines_equal_plain_loops(messages, chunk):
    specs = random_calls(random.Random(7))
    m = messages(specs)
    want_b, want_hold, want_win = set(), set(), set()
    for call, rows in by_call(specs).items():
        seen, cand = False, []
        for i, s in enumerate(rows):
            if s["what"] == "INVITE":
                if seen:
                    cand.append((s["t_rel"], i))
                seen = True
            elif s["what"] == "UPDATE":
                cand.append((s["t_rel"], i))
        cand = [c for c in cand if c[0] is not None]
        i = 0
        while i < len(cand):
            inside = [c for c in cand[i:] if c[0] - cand[i][0] <= 5.0]
            if len(inside) >= 3:
                want_b |= {(call, cand[i][1], c[1]) for c in inside}
                i += len(inside)
            else:
                i += 1
        held, first = False, True
        open_at, bye = None, None
        for i, s in enumerate(rows):
            if s["what"] == "BYE":
                bye = s["t_rel"]
            if s["what"] not in ("INVITE", "UPDATE"):
                continue
            ds = line_directions(s)
            idle, live = bool(ds) and all(d == "inactive" for d in ds), any(d != "inactive" for d in ds)
            if idle and open_at is None and s["t_rel"] is not None:
                open_at = s["t_rel"]
            elif live and open_at is not None:
                want_win.add((call, open_at, s["t_rel"]))
                open_at = None
            if s["what"] == "INVITE" and first:
                first = False
                continue
            if idle and not held:
                held = True
                want_hold.add((call, "HOLD", i))
            elif live and held:
                held = False
                want_hold.add((call, "RETRIEVE", i))
        if open_at is not None:
            want_win.add((call, open_at, bye))
    assert {tuple(r) for r in sip.burst_members(m, chunk_rows=chunk).select("call_id", "burst_idx", "msg_idx").collect()} == want_b
    assert {tuple(r) for r in timeline.hold_retrieve_events(m, chunk).select("call_id", "kind", "msg_idx").collect()} == want_hold
    assert {tuple(r) for r in timeline.hold_windows(m, chunk).select("call_id", "hold_start", "hold_end").collect()} == want_win
    assert want_b and want_hold and want_win


def test_message_order_is_stable_for_missing_times(messages):
    m = messages([dict(what="INVITE", t_rel=3.0), dict(what="ACK", t_rel=None), dict(what="BYE", t_rel=1.0), dict(what="INFO", t_rel=0.0)])
    got = msg.index_messages(m.drop("msg_idx")).orderBy("msg_idx")
    assert [(r.msg_idx, r.method) for r in got.collect()] == [(0, "ACK"), (1, "INFO"), (2, "BYE"), (3, "INVITE")]


def test_timeline_events(messages):
    m = messages([
        dict(what="INVITE", t_rel=0.0, media=[media()], has_metadata=True), dict(what=180, t_rel=0.1, reason_phrase="Ringing"), dict(what=200, t_rel=0.5), dict(what="ACK", t_rel=0.6),
        dict(what="INVITE", t_rel=5.0, media=[media("inactive")]), dict(what="UPDATE", t_rel=9.0, media=[media()]), dict(what="INVITE", t_rel=12.0, media=[media("inactive")]), dict(what="BYE", t_rel=20.0),
    ])
    kinds = [r.event_type for r in timeline.timeline_events(m).orderBy("msg_idx", "ev_no").collect()]
    assert kinds == ["invite", "metadata", "provisional", "established", "ack", "reinvite", "hold", "update", "resume", "reinvite", "hold", "bye", "terminated"]
    s = timeline.timeline_scalars(m).first()
    assert (s.established_at, s.terminated_at) == (0.5, 20.0)
    assert [(w.hold_start, w.hold_end) for w in timeline.hold_windows(m).orderBy("hold_start").collect()] == [(5.0, 9.0), (12.0, 20.0)]


def test_sip_timing(messages):
    m = messages([
        dict(what="INVITE", t_rel=0.0, via_branch="z1"), dict(what="INVITE", t_rel=0.5, via_branch="z1"), dict(what=200, t_rel=8.0), dict(what=503, t_rel=9.0, reason_phrase="Down"),
    ])
    rows = {r.code: r for d in detectors.detect_sip_timing(m) for r in d.collect()}
    assert set(rows) == {"SIP_RETRANSMISSION", "SIP_FAILURE_RESPONSE", "SIP_MISSING_ACK", "SIP_SLOW_ANSWER"}
    assert rows["SIP_RETRANSMISSION"].evidence_count == 2 and rows["SIP_FAILURE_RESPONSE"].severity == "ERROR"
    assert [r.is_retransmission for r in sip.flag_retransmissions(m).orderBy("msg_idx").collect()] == [False, True, False, False]
    t = messages([dict(what="INVITE", t_rel=t) for t in (0.0, 100.0, 190.0, 285.0, 378.0)])
    assert detectors.detect_session_timer(t, 2).first().code == "SIP_SESSION_TIMER_REFRESH"
    t = messages([dict(what="INVITE", t_rel=t) for t in (0.0, 100.0, 190.0, 330.0, 378.0)])
    assert detectors.detect_session_timer(t, 2).count() == 0


def test_compliance(messages, table):
    m = messages([dict(what="INVITE", media=[media("sendrecv")], content_type="application/rs-metadata", body="<x/>")])
    none = table(SNAPSHOT, [])
    assert [r.code for d in detectors.detect_compliance(m, none) for r in d.collect()] == ["SIPREC_NO_METADATA"]
    two = table(SNAPSHOT, [dict(msg_idx=0, raw_xml="<a/> ", n_sessions=0, n_participants=0, n_streams=0), dict(msg_idx=1, raw_xml="<a/>", n_sessions=0, n_participants=1, n_streams=1)], call_id="c1")
    rows = {r.code: r for d in detectors.detect_compliance(m, two) for r in d.collect()}
    assert set(rows) == {"SIPREC_BAD_CONTENT_TYPE", "SIPREC_METADATA_INVALID", "SIPREC_METADATA_INCOMPLETE", "SIPREC_NO_VERSION_INCREMENT", "SIPREC_BAD_DIRECTION"}
    assert rows["SIPREC_METADATA_INCOMPLETE"].detail == "Metadata is missing required element(s): session."


def test_origins_and_owners(messages):
    m = messages([dict(what="INVITE"), dict(what=488, src_ip="10.0.0.1", reason_phrase="No"), dict(what="BYE", src_ip="10.0.0.2"), dict(what=500, src_ip="9.9.9.9")])
    rows = fd.union_findings(detectors.detect_origins(m)).orderBy("sub").collect()
    assert [(r.code, r.owner, r.severity) for r in rows] == [("ERR_ORIGIN_SBC", "SBC", "WARN"), ("BYE_ORIGIN_GENESYS", "GENESYS", "INFO"), ("ERR_ORIGIN_SBC", "UNKNOWN", "ERROR")]
    none = detectors.detect_no_sdp(m)
    assert fd.assign_owner(none).first().owner == "SBC"
    odd = none.withColumn("code", F.lit("WHATEVER"))
    assert fd.assign_owner(odd).first().owner == "UNKNOWN"
    assert fd.assign_owner(none.withColumn("owner", F.lit("CAPTURE"))).first().owner == "CAPTURE"


def one_call(messages, table, n_streams=1, n_declared=2, call="c1", fail=False):
    m = messages([dict(what="INVITE", call_id=call, media=[media(label="1"), media(label="2", idx=1, port=30002)], user_agent="UA"), dict(what=200, t_rel=0.4, call_id=call, server="SRS"), dict(what="ACK", t_rel=0.5, call_id=call)]
                 + ([dict(what=500, t_rel=3.0, call_id=call)] if fail else []))
    snaps = table(SNAPSHOT, [dict(call_id=call, msg_idx=0, raw_xml="<a/>", n_sessions=1, n_participants=1, n_streams=n_declared)])
    st = table(STREAM, [dict(call_id=call, stream_idx=i, ssrc=16 + i, src_ip="10.0.0.1", src_port=30000 + i, dst_ip="10.0.0.2", dst_port=40000 + 2 * i, payload_type=0, packet_count=500,
                             first_t=1.0, last_t=9.0, sequence_gaps=0, largest_gap=0, rtcp_observed=True) for i in range(n_streams)])
    return m, snaps, st


SUMMARY = "call_id string, total bigint, sr bigint, rr bigint, report_blocks bigint"


def healthy(messages, table, **kw):
    m, snaps, st = one_call(messages, table, **kw)
    f = fd.union_findings([*detectors.detect_origins(m), detectors.detect_no_sdp(m)])
    return health.call_health(health.call_facts(m, snaps, st, table(SUMMARY, [dict(call_id="c1", total=3, sr=1, rr=2, report_blocks=2)]), fd.assign_owner(f)))


def test_health_rollup(messages, table):
    h = healthy(messages, table, n_streams=2).first()
    assert {h[f"status_{n}"] for n in ("sip", "sdp", "rtp", "rtcp", "streams", "gaps")} == {"PASS"} and h.overall_health == "WARN"
    h = healthy(messages, table, n_streams=1).first()
    assert h.status_streams == "WARN" and h.status_metadata == "WARN"
    h = healthy(messages, table, n_streams=0).first()
    assert (h.status_rtp, h.status_streams, h.overall_health) == ("ERROR", "ERROR", "ERROR")
    assert healthy(messages, table, n_streams=2, fail=True).first().overall_health == "ERROR"


def test_summary_and_cards(messages, table):
    h = healthy(messages, table, n_streams=1)
    lines = report.summary_text(h).first().summary.split("\n")
    assert len(lines) == 17 and lines[2] == "START:        2023-11-14T22:13:20.000Z" and lines[4] == "DURATION:     00:00:00.500" and lines[10] == "STREAMS:      2 declared / 1 observed"
    cards = {r.name: (r.status, r.detail) for r in report.status_cards(h).collect()}
    assert len(cards) == 8 and cards["RTCP"] == ("PASS", "2 reception reports")
    assert report.summary_records(h).first().status.streams == "WARN"


def test_batch(messages, table, spark):
    rows = [dict(call_id="a", overall_health="ERROR", declared=2, observed=1, start_epoch=1700000000.0), dict(call_id="b", overall_health="PASS", declared=2, observed=1, start_epoch=1700090000.0)]
    h = table("call_id string, overall_health string, declared bigint, observed bigint, start_epoch double", rows)
    bursts = table("call_id string, codec_renegotiation boolean", [dict(call_id="a", codec_renegotiation=True)])
    asked = table("call_id string", [dict(call_id="a"), dict(call_id="zz")])
    t = batch.batch_totals(h, bursts, asked).first()
    assert (t.calls, t.failed, t.failure_rate, t.one_way_calls, t.codec_flap_calls, t.calls_not_found) == (2, 1, 0.5, 2, 1, 1)
    assert [tuple(r) for r in batch.daily_series(h).collect()] == [("2023-11-14", 1, 1), ("2023-11-15", 1, 0)]


def test_baseline(messages, table):
    m, snaps, st = one_call(messages, table, n_streams=2)
    good = baseline.call_profiles(m, snaps, st, identity.fingerprints(m))
    g = good.first()
    assert (g.declared_streams, g.observed_streams, g.fingerprint_banners, g.media_directions, g.codec_sets) == (2, 2, ["UA"], ["sendonly"], [["0"]])
    assert baseline.diff_against_baseline(good, good).count() == 0
    m, snaps, st = one_call(messages, table, n_streams=1)
    bad = baseline.call_profiles(m, snaps, st, identity.fingerprints(m)).withColumn("media_directions", F.array(F.lit("sendonly"), F.lit("sendrecv"))).withColumn("codec_sets", F.array(F.array(F.lit("9"))))
    got = {r.title: r.detail for r in baseline.diff_against_baseline(bad, good).collect()}
    assert got["Differs from baseline: observed streams"] == "Baseline observed streams = 2; this call = 1."
    assert got["Differs from baseline: codec set"] == "Codec set(s) not seen in the baseline: [['9']]."
    assert got["Differs from baseline: media directions"].endswith("this call = ['sendonly', 'sendrecv'].") and len(got) == 3


def test_correlation_key_and_ladder(messages, table):
    m, _, st = one_call(messages, table)
    people = table(RS_PARTICIPANT, [dict(call_id="c1", msg_idx=0, ord=0, participant_id="p", aor="sip:agent@cc")])
    k = identity.correlation_keys(m, identity.correlation_parts(m, people, st)).first()
    assert k.participant_aors == ["sip:agent@cc"] and k.ssrcs == ["0x00000010"] and k.start_utc.startswith("2023-11-14T22:13:20.000000")
    k = identity.correlation_keys(m, identity.correlation_parts(m, people.limit(0), st)).first()
    assert k.participant_aors == ["sip:dst@b", "sip:src@a"]
    m2 = m.withColumn("src_ip", F.when(F.col("status_code").isNotNull(), "10.0.0.2").otherwise(F.col("src_ip")))
    rows = identity.ladder_rows(m2).orderBy("index").collect()
    assert [(r.label, r.direction, r.to_actor) for r in rows] == [("INVITE + SDP", "SRC_TO_SRS", "SRS"), ("200 OK", "SRS_TO_SRC", "SRC"), ("ACK", "SRC_TO_SRS", "SRS")]
    fp = {r.actor: r for r in identity.fingerprints(m2).collect()}
    assert fp["SRC/SBC"].user_agent == "UA" and fp["SRS/recorder"].server == "SRS"


def test_consistency_and_labels(messages, table):
    counts = table("call_id string, sdp_count bigint, declared bigint, distinct_media bigint, observed bigint", [dict(call_id="c1", sdp_count=1, declared=2, distinct_media=1, observed=1)])
    rows = [r for d in detectors.detect_consistency(counts) for r in d.collect()]
    assert [(r.code, r.severity, r.owner) for r in rows] == [("CONSIST_METADATA_RTP", "ERROR", "SBC"), ("CONSIST_METADATA_SDP", "WARN", "SBC")]
    assert [r.code for d in detectors.detect_stream_counts(counts) for r in d.collect()] == ["MIX_FEWER_OBSERVED", "MIX_SDP_COUNT_MISMATCH"]
    _, _, st = one_call(messages, table)
    rs = table(RS_STREAM, [dict(call_id="c1", msg_idx=0, ord=0, stream_id="s", label="9"), dict(call_id="c1", msg_idx=0, ord=1, stream_id="t", label="10")])
    assert "['10', '9']" in detectors.detect_unbound_labels(rs, st).first().detail
    assert detectors.detect_unbound_labels(rs, st.withColumn("matched_sdp_label", F.lit("9"))).count() == 0
