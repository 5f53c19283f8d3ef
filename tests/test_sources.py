import glob
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from tapline.operators import messages as msg
from tapline.operators import report
from tapline.plans import driver_queries
from tapline.plans.analyze import Options, analyze, parquet_stage, signalling_tables
from tapline.plans.driver_views import DriverViews
from tapline.sources import captures, fields, packet_json, packets, sinks

XML = (
    "<recording xmlns='urn:ietf:params:xml:ns:recording:1'><session session_id='x'/><participant participant_id='p1'><nameID aor='sip:a@cc'><name>Ann</name></nameID></participant>"
    "<stream stream_id='S1' session_id='x'><label>1</label></stream><stream stream_id='S2' session_id='x'><label>2</label></stream>"
    "<participantstreamassoc participant_id='p1'><send>S1</send><recv>S2</recv></participantstreamassoc></recording>"
)


def ip4(text):
    return bytes(int(x) for x in text.split("."))


def frame(src, sport, dst, dport, payload, vlan=False, six=False):
    udp = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    if six:
        ip = b"\x60\0\0\0" + struct.pack(">HBB", len(udp), 17, 64) + bytes(12) + ip4(src) + bytes(12) + ip4(dst) + udp
        kind = b"\x86\xdd"
    else:
        ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0) + ip4(src) + ip4(dst) + udp
        kind = b"\x08\x00"
    return bytes(12) + (b"\x81\x00\x00\x07" if vlan else b"") + kind + ip


def rtp(ssrc, seq, pt=0):
    return struct.pack(">BBHII", 0x80, pt, seq, 0, ssrc) + bytes(20)


def receiver_report(about, fraction, lost, jitter):
    return struct.pack(">BBHI", 0x81, 201, 7, 1) + struct.pack(">I", about) + bytes([fraction]) + lost.to_bytes(3, "big") + struct.pack(">III", 0, jitter, 0) + bytes(4)


def sip_invite(call, cseq, sdp_dir="sendonly", metadata=True):
    sdp = f"v=0\r\no=- 1 1 IN IP4 10.0.0.1\r\ns=-\r\nm=audio 30000 RTP/AVP 0\r\na=label:1\r\na={sdp_dir}\r\nm=audio 30010 RTP/AVP 0\r\na=label:2\r\na={sdp_dir}\r\n"
    body = f"--bb\r\nContent-Type: application/sdp\r\n\r\n{sdp}\r\n--bb\r\nContent-Type: application/rs-metadata+xml\r\n\r\n{XML}\r\n--bb--\r\n" if metadata else sdp
    ctype = "multipart/mixed;boundary=bb" if metadata else "application/sdp"
    return (f"INVITE sip:rec@b SIP/2.0\r\nVia: SIP/2.0/UDP 10.0.0.1:5060;branch=z9hG4bK{cseq}\r\nCall-ID: {call}\r\nCSeq: {cseq} INVITE\r\nUser-Agent: Box\r\nContent-Type: {ctype}\r\n\r\n{body}").encode()


def sip_reply(call, cseq, code=200, phrase="OK"):
    return f"SIP/2.0 {code} {phrase}\r\nCall-ID: {call}\r\nCSeq: {cseq} INVITE\r\nServer: Rec\r\n\r\n".encode()


def sip_plain(call, method, cseq):
    return f"{method} sip:rec@b SIP/2.0\r\nCall-ID: {call}\r\nCSeq: {cseq} {method}\r\n\r\n".encode()


def session(call="call@1", base=1700000000.0):
    """A recorded call: second leg changes its SSRC at a retrieve."""
    a, b = "10.0.0.1", "10.0.0.2"
    out = [(0.0, frame(a, 5060, b, 5060, sip_invite(call, 1))), (0.2, frame(b, 5060, a, 5060, sip_reply(call, 1))), (0.3, frame(a, 5060, b, 5060, sip_plain(call, "ACK", 1)))]
    for i in range(120):
        out.append((1.0 + i * 0.02, frame(a, 30000, b, 40000, rtp(0x11, i if i < 60 else i + 3), vlan=i % 2 == 0)))
        out.append((1.0 + i * 0.02, frame(a, 30010, b, 40010, rtp(0x22, i), six=False)))
    out.append((3.0, frame(b, 40001, a, 30001, receiver_report(0x11, 64, 9, 400))))
    out.append((5.0, frame(a, 5060, b, 5060, sip_invite(call, 2, "inactive", False))))
    out.append((7.0, frame(a, 5060, b, 5060, sip_invite(call, 3, "sendonly", False))))
    for i in range(120):
        out.append((7.5 + i * 0.02, frame(a, 30010, b, 40010, rtp(0x99, 500 + i))))
    out.append((12.0, frame(a, 5060, b, 5060, sip_plain(call, "BYE", 4))))
    return [(base + t, f) for t, f in sorted(out, key=lambda x: x[0])]


def write_pcap(path, rows, order="<", nanos=False, snap=65535, cut=None):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, snap, 1))
        for t, data in rows:
            sec = int(t)
            frac = round((t - sec) * (1e9 if nanos else 1e6))
            kept = data[:cut] if cut else data
            f.write(struct.pack(order + "IIII", sec, frac, len(kept), len(data)) + kept)


def write_pcapng(path, rows):
    def block(kind, body):
        pad = -len(body) % 4
        size = 12 + len(body) + pad
        return struct.pack("<II", kind, size) + body + bytes(pad) + struct.pack("<I", size)

    with open(path, "wb") as f:
        f.write(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)))
        f.write(block(1, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3xHH", 9, 1, 9, 0, 0)))
        for t, data in rows:
            ticks = round(t * 1e6) * 1000
            f.write(block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data))


@pytest.fixture(scope="module")
def capture_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("caps")
    rows = session()
    write_pcap(d / "b.pcap", rows[: len(rows) // 2])
    write_pcapng(d / "c.pcapng", rows[len(rows) // 2:])
    write_pcap(d / "a.cap", session("call@2", 1700090000.0), order=">", nanos=True)
    (d / "notes.txt").write_text("no capture")
    return str(d)


def test_listing_and_index(spark, capture_dir, tmp_path):
    files = captures.list_captures(spark, capture_dir, directory=True)
    assert [os.path.basename(r.file) for r in files.collect()] == ["a.cap", "b.pcap", "c.pcapng"]
    idx = {os.path.basename(r.file): r for r in captures.index_captures(files).collect()}
    assert idx["a.cap"].format_hint == "pcap" and idx["a.cap"].first_packet_time == 1700090000.0
    assert idx["b.pcap"].first_packet_time == 1700000000.0 and idx["c.pcapng"].format_hint == "pcapng" and idx["c.pcapng"].first_packet_time is None
    bad = captures.index_captures(captures.list_captures(spark, capture_dir + "/notes.txt")).first()
    assert not bad.readable and bad.error
    with pytest.raises(Exception):
        captures.list_captures(spark, str(tmp_path), directory=True)


def test_quality_and_custody(spark, tmp_path):
    import hashlib

    write_pcap(tmp_path / "x.pcap", session()[:5], snap=64, cut=64)
    files = captures.list_captures(spark, str(tmp_path), directory=True)
    ranges = packets.record_ranges(files, size=2)
    q = captures.file_quality(files, ranges).first()
    assert q.sha256 == hashlib.sha256((tmp_path / "x.pcap").read_bytes()).hexdigest() and (q.n_records, q.snaplen, q.truncated) == (5, 64, True)
    calls = spark.createDataFrame([("c", 0)], "call_id string, file_idx int")
    drops = spark.createDataFrame([(0, 7)], "file_idx int, drops bigint")
    c = captures.capture_quality(captures.file_quality(files, ranges), calls, drops)
    from tapline.operators import detectors

    assert [r.code for d in detectors.detect_capture(c) for r in d.collect()] == ["CAP_TRUNCATED", "CAP_DROPS"]


def test_quality_of_files_of_all_kinds(spark, capture_dir, tmp_path):
    """Records of split walks and pcapng blocks are counted; empty and foreign files have none."""
    import shutil

    for name in ("a.cap", "b.pcap", "c.pcapng"):
        shutil.copy(os.path.join(capture_dir, name), tmp_path / name)
    write_pcap(tmp_path / "d.pcap", [(1.7e9 + i, bytes(300)) for i in range(60)], snap=100, cut=100)
    write_pcap(tmp_path / "e.pcap", [])
    (tmp_path / "f.pcap").write_bytes(b"no capture at all")
    files = captures.list_captures(spark, str(tmp_path), directory=True)
    got = {os.path.basename(r.file): r for r in captures.file_quality(files, packets.record_ranges(files, 7, 900)).collect()}
    n = len(session())
    assert [(k, r.n_records, r.truncated) for k, r in sorted(got.items())] == [("a.cap", n, False), ("b.pcap", n // 2, False), ("c.pcapng", n - n // 2, False), ("d.pcap", 60, True), ("e.pcap", 0, False), ("f.pcap", 0, False)]
    assert got["d.pcap"].snaplen == 100 and got["f.pcap"].snaplen is None and all(len(r.sha256) == 64 for r in got.values())


def test_ranges_cut_a_file_without_changing_it(spark, capture_dir):
    files = captures.list_captures(spark, capture_dir, directory=True)

    def rows(size, split=1 << 30):
        f = packets.read_frames(packets.record_ranges(files, size, split))
        return sorted((r.file_idx, r.frame_number, round(r.ts_epoch, 6), round(r.t_rel, 6), bytes(r.frame)) for r in f.collect())

    whole = rows(100_000)
    assert len(whole) == 2 * len(session()) and rows(7) == whole
    assert rows(100_000, 5000) == whole and rows(11, 3000) == whole
    assert [r[1] for r in whole if r[0] == 1] == list(range(1, len(session()) // 2 + 1))


def test_a_split_that_guesses_wrong_is_walked_again(spark, tmp_path):
    """Payloads made of capture records mislead the search for a boundary."""
    trap = b"".join(struct.pack("<IIII", 1700000000, 5, 4, 4) + b"wxyz" for _ in range(60))
    rows = [(1700000000.0 + i, trap) for i in range(40)]
    write_pcap(tmp_path / "t.pcap", rows)
    files = captures.list_captures(spark, str(tmp_path), directory=True)
    got = packets.read_frames(packets.record_ranges(files, 9, 2500)).orderBy("frame_number").collect()
    assert [r.frame_number for r in got] == list(range(1, 41)) and all(bytes(r.frame) == trap for r in got)


def test_capture_to_findings(spark, capture_dir, tmp_path):
    files = captures.list_captures(spark, capture_dir, directory=True)
    packet_rows, sip_rows = packets.read_packets(files, 50)
    keep = parquet_stage(spark)
    packet_rows, sip_rows = keep("packets", packet_rows), keep("raw_sip", sip_rows)
    assert sip_rows.count() == 12
    sig = signalling_tables(sip_rows)
    out = analyze(sig, packet_rows, Options(time_bound=True), keep=keep)
    one = {n: d.where("call_id = 'call@2'") for n, d in out.items() if "call_id" in d.columns}
    st = {r.ssrc: r for r in one["rtp_streams"].collect()}
    assert set(st) == {0x11, 0x22, 0x99} and st[0x11].sequence_gaps == 1 and st[0x11].largest_gap == 3
    assert (st[0x99].matched_sdp_label, st[0x99].matched_siprec_stream_id, st[0x99].participant_name) == ("2", "S2", "Ann")
    codes = {r.code for r in one["findings"].collect()}
    assert {"SIPREC-001", "SIPREC-002", "SIPREC-004", "RTP_SEQ_GAP", "RTP_SSRC_CHANGE", "RTCP_HIGH_LOSS", "RTP_EARLY_END", "BYE_ORIGIN_SBC"} <= codes
    assert "SIPREC_NO_METADATA" not in codes and "NO_SDP" not in codes
    h = one["call_health"].first()
    assert (h.overall_health, h.declared, h.observed, h.src_ip, h.srs_ip) == ("CRITICAL", 2, 3, "10.0.0.1", "10.0.0.2")
    texts = [r.text for r in one["narrative"].orderBy("index").collect()]
    assert texts[0] == "the SBC sent an INVITE to the recorder carrying SIPREC metadata that declared 2 stream(s)." and texts[1] == "the recorder answered 200 OK."
    assert texts[-1] == "In total, 2 of 2 declared stream(s) carried media to the recorder."
    lines = report.escalation_lines(out["call_health"], out["narrative"], out["findings"], out["fingerprints"], out["rtp_streams"])
    sinks.write_text_by_call(lines, str(tmp_path / "md"), ["section", "k1", "k2", "k3"])
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "md" / "case=call_at_2")).collect())
    assert "# SIPREC recording analysis — call@2" in text and "### SBC (provable from this capture)" in text and "| 0x00000099 | 10.0.0.2:40010 |" in text
    sinks.write_case_tables({"findings": out["findings"]}, str(tmp_path / "case"))
    part = [f for f in os.listdir(tmp_path / "case" / "findings" / "case=call_at_2") if f.endswith(".json")]
    assert part and all(json.loads(line)["call_id"] == "call@2" for f in part for line in open(tmp_path / "case" / "findings" / "case=call_at_2" / f))
    sinks.write_focused_packets(keep("focused", packet_rows.limit(0).selectExpr("'x' as call_id", "*")), str(tmp_path / "fp"))


def test_capture_quality_in_the_analysis(spark, tmp_path):
    """Findings about the capture come from the same walk that reads the packets."""
    rows = session()
    write_pcap(tmp_path / "x.pcap", rows[:-1] + [(rows[-1][0], rows[-1][1])], snap=2000)
    write_pcap(tmp_path / "y.pcap", [(rows[-1][0] + 1, bytes(60))] * 3, snap=40, cut=40)
    keep = parquet_stage(spark)
    files = captures.list_captures(spark, str(tmp_path), directory=True)
    ranges = keep("ranges", packets.record_ranges(files, 50))
    packet_rows, sip_rows = packets.read_packets(files, ranges=ranges)
    own = sip_rows.select("call_id", "file_idx").union(sip_rows.select("call_id", F.lit(1)))
    quality = captures.capture_quality(captures.file_quality(files, ranges), own)
    out = analyze(signalling_tables(sip_rows), packet_rows, Options(), quality=quality, keep=keep)
    found = out["findings"].where("code = 'CAP_TRUNCATED'").collect()
    assert len(found) == 1 and "snaplen of 40" in found[0].detail


def test_rtcp_of_the_whole_capture(spark, capture_dir):
    """With the capture scope every call gets the RTCP of the files it appears in."""
    from tapline.plans.analyze import rtcp_rows, scoped_packets

    files = captures.list_captures(spark, capture_dir + "/a.cap")
    keep = parquet_stage(spark)
    packet_rows, sip_rows = (keep(n, d) for n, d in zip(("p", "s"), packets.read_packets(files)))
    sig = signalling_tables(sip_rows)
    stray = packet_rows.where("rtcp_pt <> ''").withColumn("src_port", F.lit(9)).withColumn("dst_port", F.lit(11))
    both = packet_rows.unionByName(stray)

    def count(opts):
        return rtcp_rows(sig, both, scoped_packets(sig, both, opts), opts).count()

    assert count(Options()) == 1 and count(Options(rtcp_scope="capture")) == 2


def test_calls_together_equal_calls_alone(spark, capture_dir):
    files = captures.list_captures(spark, capture_dir, directory=True)
    packet_rows, sip_rows = packets.read_packets(files)
    keep = parquet_stage(spark)
    packet_rows, sip_rows = keep("packets", packet_rows), keep("sip", sip_rows)

    def findings(call_filter, name):
        sig = signalling_tables(sip_rows.where(call_filter))
        stage = parquet_stage(spark)
        out = analyze(sig, packet_rows, Options(time_bound=True), keep=lambda n, d: stage(name + n, d))
        return sorted(map(str, out["findings"].collect()))

    assert findings("true", "both") == sorted(findings("call_id = 'call@1'", "one") + findings("call_id = 'call@2'", "two"))


def test_field_exports_with_drift(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("frame.number\tframe.time_relative\tip.src\tudp.srcport\trtp.ssrc\n1\t0.5\t10.0.0.1\t7\t0x10\n2\t0.6\t10.0.0.1\n")
    (tmp_path / "a.tsv").write_text("frame.number\trtcp.pt\tipv6.src\tframe.time_relative\n9\t200,202\t2001:db8::1\tbad\n")
    (tmp_path / "c.tsv").write_text("ip.src\tframe.time_relative\n10.0.0.7\t0.25\n")
    rows = fields.read_field_rows(spark, str(tmp_path))
    got = [tuple(r) for r in fields.typed_packets(rows).orderBy("file_idx", "frame_number").select("file_idx", "frame_number", "t_rel", "src_ip", "src_port", "ssrc", "rtcp_pt").collect()]
    assert got == [(0, 9, None, "2001:db8::1", None, None, "200,202"), (1, 1, 0.5, "10.0.0.1", 7, 16, ""), (1, 2, 0.6, "10.0.0.1", None, None, ""), (2, 0, 0.25, "10.0.0.7", None, None, "")]


def test_header_is_the_first_line(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("frame.number\t_ws.col.Info\tip.src\n1\thost.example\t10.0.0.1\n")
    (tmp_path / "b.tsv").write_text("plain\tframe.number\nhost.example\t2\n")
    (tmp_path / "c.tsv").write_text("ip.src\nhost.example\n")
    (tmp_path / "d.tsv").write_text("")
    rows = fields.read_field_rows(spark, str(tmp_path))
    assert sorted((os.path.basename(r.file), r.frame_number, r.ip_src) for r in rows.collect()) == [("a.tsv", "1", "10.0.0.1"), ("b.tsv", "2", ""), ("c.tsv", "", "host.example")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    (tmp_path / "e.tsv").write_text("\n1\t2\n")
    with pytest.raises(Exception, match="no header line"):
        fields.read_field_rows(spark, str(tmp_path)).collect()


def test_all_packet_blocks_of_pcapng(spark, tmp_path):
    f = [frame("10.0.0.1", 40000, "10.0.0.2", 40002, rtp(7, i)) for i in range(4)]

    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    n = len(f[0])
    raw = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    raw += block(6, struct.pack("<IIIII", 0, 0, 5_000_000, n, n) + f[0]) + block(3, struct.pack("<I", n) + f[1])
    raw += block(2, struct.pack("<HHIIII", 0, 0, 0, 6_000_000, n, n) + f[2]) + block(5, bytes(8)) + block(3, struct.pack("<I", n) + f[3])
    (tmp_path / "x.pcapng").write_bytes(raw)
    for size in (1, 100):
        packet_rows, _ = packets.read_packets(captures.list_captures(spark, str(tmp_path), directory=True), size=size)
        got = [(r.frame_number, r.seq, r.ts_epoch) for r in packet_rows.orderBy("frame_number").collect()]
        assert got == [(1, 0, 5.0), (2, 1, 5.0), (3, 2, 6.0), (4, 3, 6.0)]


def test_fragments_are_rejoined(spark):
    payload = sip_invite("frag@1", 1) + b" " * 3000
    whole = frame("10.0.0.1", 5060, "10.0.0.2", 5060, payload)
    head, data = whole[:14], whole[34:]

    def piece(at, end, ident, src="10.0.0.1"):
        word = at // 8 | (0x2000 if end < len(data) else 0)
        part = data[at:end]
        return head + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(part), ident, word, 64, 17, 0) + ip4(src) + ip4("10.0.0.2") + part

    cuts = [(0, 1480), (1480, 2960), (2960, len(data))]
    rows = [piece(*c, 9) for c in cuts] + [piece(*c, 9) for c in cuts] + [piece(*cuts[0], 11), piece(*cuts[2], 11)] + [piece(*c, 9, "10.0.0.3") for c in cuts]
    df = spark.createDataFrame([(0, i + 1, i / 10, i / 10, 1, f) for i, f in enumerate(rows)], "file_idx int, frame_number bigint, ts_epoch double, t_rel double, link int, frame binary")
    got = packets.decode_udp(df).orderBy("frame_number").collect()
    assert [(r.frame_number, r.src_ip, r.src_port, bytes(r.payload) == payload) for r in got] == [(3, "10.0.0.1", 5060, True), (6, "10.0.0.1", 5060, True), (11, "10.0.0.3", 5060, True)]


def fragments_of(datagram, sizes, ident, six=False, src=1, options=b""):
    """Frames of the pieces of a datagram (IPv6: with hop-by-hop options before the fragment header)."""
    out, at = [], 0
    for k, n in enumerate(sizes):
        part, more = datagram[at : at + n], k < len(sizes) - 1
        if six:
            chain = bytes([44, 0, 1, 4, 0, 0, 0, 0]) + struct.pack(">BBHI", 60 if options else 17, 0, at | more, ident)
            head = struct.pack(">IHBB", 6 << 28, len(chain) + len(part), 0, 64) + bytes(15) + bytes([src]) + bytes(15) + b"\x09" + chain
            out.append((k, bytes(12) + b"\x86\xdd" + head + part + b"pad"))
        else:
            head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(part), ident, (0x2000 if more else 0) | at // 8, 64, 17, 0) + bytes([10, 0, 0, src, 10, 0, 0, 9])
            out.append((k, bytes(12) + b"\x08\x00" + head + part + b"pad"))
        at += n
    return [f for _, f in out]


def udp_datagram(port, payload):
    return struct.pack(">HHHH", port, 5060, 8 + len(payload), 0) + payload


def decoded(spark, *cases):
    """(frame, source port, payload) of the datagrams of every case, a list of (time, frame); a case is a file."""
    rows = [(c, i + 1, t, t, 1, f) for c, case in enumerate(cases) for i, (t, f) in enumerate(case)]
    df = spark.createDataFrame(rows, "file_idx int, frame_number bigint, ts_epoch double, t_rel double, link int, frame binary")
    out = [[] for _ in cases]
    for r in packets.decode_udp(df).orderBy("file_idx", "frame_number").collect():
        out[r.file_idx].append((r.frame_number, r.src_port, bytes(r.payload)))
    return out


@pytest.mark.parametrize("six", [False, True])
def test_fragments_in_any_order(spark, six):
    a, b, c = (bytes([x]) * 60 for x in b"abc")
    cut = lambda port, body, ident: fragments_of(udp_datagram(port, body), (24, 24, 20), ident, six)
    p, q, r, s = cut(1, a, 7), cut(2, b, 7), cut(3, c, 8), cut(1, a[:40] + b[:20], 7)
    doubled = (p[2], p[2], p[0], p[0], p[1], p[1], p[0])
    cases = [
        *[([p[k] for k in order], [(3, 1, a)]) for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0), (2, 0, 1))],
        # Interleaved with another number, doubled before and after completion, the number used again.
        ((p[2], r[0], p[1], r[2], p[0], r[1]), [(5, 1, a), (6, 3, c)]),
        (doubled, [(5, 1, a)]),
        ((*doubled, q[2], q[0], q[1]), [(5, 1, a), (10, 2, b)]),
        ((*p, *reversed(p)), [(3, 1, a), (6, 1, a)]),
        # The next datagram shares its first bytes with the one before, and they come first.
        ((*p, s[0], s[2], s[1]), [(3, 1, a), (6, 1, a[:40] + b[:20])]),
        # A lost piece: the number's next datagram is not mixed with what is left.
        ((p[0], p[2], q[2], q[0], q[1]), [(5, 2, b)]),
    ]
    pause = [(0.0, p[0]), (0.0, p[1]), (60.0, q[2]), (60.0, q[1])]
    got = decoded(spark, *[[(0.0, f) for f in case] for case, _ in cases], pause)
    assert got == [want for _, want in cases] + [[]]


def test_overlapping_fragments_and_headers_behind_the_fragment_header(spark):
    whole = udp_datagram(4, bytes(range(64)))
    head = lambda at, n, more: struct.pack(">BBHHHBBH", 0x45, 0, 20 + n, 5, (0x2000 if more else 0) | at // 8, 64, 17, 0) + bytes([10, 0, 0, 1, 10, 0, 0, 9])
    parts = [bytes(12) + b"\x08\x00" + head(at, n, at + n < 72) + whole[at : at + n] for at, n in ((40, 32), (0, 32), (16, 40))]
    cases = [[(0.0, f) for f in parts]]
    options = bytes([17, 0, 1, 4, 0, 0, 0, 0])
    behind = fragments_of(options + whole, (32, 48), 6, six=True, options=options)
    cases.append([(0.0, f) for f in reversed(behind)])
    assert decoded(spark, *cases) == [[(3, 4, bytes(range(64)))], [(2, 4, bytes(range(64)))]]


def test_fragments_of_one_pair_of_hosts_are_spread(spark):
    """Numbers, not hosts, make the partitions, and there is no window over a host's fragments."""
    rows = [(0, 1, 0.0, 0.0, 1, b"")]
    df = spark.createDataFrame(rows, "file_idx int, frame_number bigint, ts_epoch double, t_rel double, link int, frame binary")
    plan = packets.decode_udp(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "RepartitionByExpression [file_idx" in plan and "ident" in plan


def test_packet_json(spark, tmp_path):
    layers = {"frame": {"frame.number": "7", "frame.time_relative": "1.250"}, "ip": {"ip.src": ""}, "ipv6": {"ipv6.src": "2001::5"}, "tcp": {"tcp.srcport": "5061"},
              "sip": {"sip.Method": "invite", "sip.Call-ID": "xyz@host", "sip.list": ["sip.CSeq", "zz"], "tree": [{"sip.CSeq": '1 "q" INVITE'}, {"sip.CSeq": "2"}], "sip.msg_hdr": "A: b\r\nC: d"}}
    (tmp_path / "p.json").write_text(json.dumps([{"_source": {"layers": layers}}, {"_source": {"layers": {"frame": {"frame.number": "8"}}}}], indent=1))
    r = packet_json.read_packet_json(spark, str(tmp_path)).first()
    assert (r.frame_number, r.t_rel, r.src_ip, r.src_port, r.method, r.call_id, r.cseq, r.raw_headers) == (7, 1.25, "2001::5", 5061, "INVITE", "xyz@host", '1 "q" INVITE', "A: b\r\nC: d")
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "p.jsonl").write_text(json.dumps(layers) + "\n")
    assert packet_json.read_packet_json(spark, str(tmp_path / "l"), json_lines=True).count() == 1


def test_packet_json_of_any_length_and_depth(spark, tmp_path):
    """Strings of a megabyte full of escapes, layers hundreds deep, bare packets, doubled fields, broken lines."""
    body = 'a="b"\r\n\\u00e9 \\\\ "sip.CSeq": "no" ' * 40_000
    deep = {"sip.Call-ID": "deep", "sip.msg_body": body}
    for _ in range(300):
        deep = {"layer": [deep, {"x": "sip.To"}]}
    packets_ = [
        {"_source": {"layers": {"sip": {"sip.Call-ID": "long", "sip.msg_body": body, "sip.tree": {"sip.CSeq": "1 INVITE"}, "sip.To": 5, "t": {"sip.To": "<sip:t>"}}}}},
        {"_source": {"layers": {"sip": deep}}},
        {"frame": {"frame.number": "3"}, "sip": {"sip.Call-ID": "bare", "sip.Method": "bye"}},
        {"frame.number": "4", "sip.Call-ID": "flat", "sip.Method": "ack", "sip.From": 'a "q"'},
        {"_source": {"layers": {"sip": {"sip.Call-ID": "first", "again": {"sip.Call-ID": "second"}, "sip.Via": ["x", "y"]}}}},
        {"_source": {"layers": {"sip": {"sip.Call-ID": {"sip.none": "z"}, "sip.other": "w"}}}},
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "p.json").write_text(json.dumps(packets_, indent=2))
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "p.json").write_text("\n".join(json.dumps(x) for x in packets_) + '\n{"sip.Call-ID": "torn')
    for path, lines in (("a", False), ("l", True)):
        got = {r.call_id: r for r in packet_json.read_packet_json(spark, str(tmp_path / path), json_lines=lines).collect()}
        assert set(got) == {"long", "deep", "bare", "flat", "first"}
        assert got["long"].body == body and got["deep"].body == body
        assert (got["long"].cseq, got["long"].to_header) == ("1 INVITE", "<sip:t>")
        assert (got["bare"].frame_number, got["bare"].method, got["flat"].frame_number, got["flat"].from_header) == (3, "BYE", 4, 'a "q"')
        assert got["first"].via_sent_by is None


def test_ipv6_text(spark):
    f = frame("10.0.0.1", 1, "10.0.0.2", 2, rtp(1, 1), six=True)
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 1, f)], "file_idx int, frame_number bigint, ts_epoch double, t_rel double, link int, frame binary")
    assert packets.decode_udp(df).first().src_ip == "::a00:1"


def test_filter_calls(messages, spark):
    m = messages([dict(what="INVITE", call_id="a"), dict(what="INVITE", call_id='b"\\'), dict(what="INVITE", call_id="c")])
    assert msg.filter_calls(m, 'b"\\').count() == 1
    assert msg.filter_calls(m, spark.createDataFrame([("a",), ("c",), ("a",)], "call_id string")).count() == 2
    assert m.where(F.col("call_id") == "zz").count() == 0


def test_array_exports_are_cut_into_whole_arrays(spark, monkeypatch):
    """Each file of the export is one valid array of at most so many packets, with all of them in all."""
    monkeypatch.setattr(driver_queries, "ARRAY_PACKETS", 50)
    v = DriverViews(spark, "/root/testdata/sf0.001")
    _, arrays = driver_queries._json_exports(v)
    found = [json.load(open(f)) for f in glob.glob(f"{arrays.removeprefix('file://')}/*.txt")]
    assert all(a[-1] == {} and len(a) <= 51 for a in found) and len(found) > 5
    want = driver_queries._packet_objects(v).where("frame_number % 2 <> 0").count()
    assert sum(len(a) - 1 for a in found) == want


def test_small_cases_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('call-', id) as call_id", "id as stream_idx")
    sinks.write_case_tables({"rtp_streams": rows}, str(tmp_path))
    files = [f.name for f in (tmp_path / "media-streams").rglob("part-*.json")]
    assert len(files) == 400 and len({f.split("-")[1] for f in files}) > 1
    back = spark.read.json(f"{tmp_path}/media-streams")
    assert back.count() == 400 and back.select("case").distinct().count() == 400


def test_packet_exports_are_compressed_and_read_without_a_shuffle_of_messages(spark, tmp_path, monkeypatch):
    """Files of both forms stay bounded, compressed ones give the rows of plain ones, and their index is broadcast whatever the threshold."""
    monkeypatch.setattr(driver_queries, "ARRAY_PACKETS", 50)
    roots = [str(tmp_path / name) for name in ("plain", "packed")]
    monkeypatch.setattr(driver_queries, "work_path", lambda spark, name, left=iter(roots): next(left))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = DriverViews(spark, "/root/testdata/sf0.001")
        size = lambda at: sum(os.path.getsize(f) for f in glob.glob(f"{at}/part-*"))
        plain = driver_queries._json_exports(v)
        rows = driver_queries.QUERIES["src2_packet_json"](spark, "/root/testdata/sf0.001")
        packed = roots[1]
        assert size(f"{packed}/lines") < size(plain[0]) / 3 and size(f"{packed}/arrays") < size(plain[1]) / 3
        assert all(r["count"] <= 50 for r in spark.read.text(f"{packed}/lines").groupBy(F.input_file_name()).count().collect())
        for at, lines in zip(plain, (True, False)):
            again = packet_json.read_packet_json(spark, f"{packed}/{os.path.basename(at)}", json_lines=lines).drop("file_idx")
            want = packet_json.read_packet_json(spark, at, json_lines=lines).drop("file_idx")
            assert want.count() and again.exceptAll(want).count() == 0 == want.exceptAll(again).count()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
