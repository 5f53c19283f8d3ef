import pytest
from pyspark.sql import functions as F

from tapline.functions import scalars as sc
from tapline.functions import sdp, text
from tapline.functions.rs_metadata import metadata_xml, parse_rs_metadata

XML = (
    "<?xml version='1.0'?><recording xmlns='urn:ietf:params:xml:ns:recording:1' xmlns:v='urn:vendor'>"
    "<session session_id='se1'/><participant participant_id='pB'><nameID aor='sip:b@x.example'><name>Bea</name></nameID></participant>"
    "<participant participant_id='pA'><nameID aor='sip:a@x.example'/></participant>"
    "<stream stream_id='s1' session_id='se1'><label>96</label><v:tag>q</v:tag></stream>"
    "<stream stream_id='s2' session_id='se1'><label>97</label></stream>"
    "<participantsessionassoc participant_id='pB' session_id='se1'/>"
    "<participantstreamassoc participant_id='pB'><send>s1</send><recv>s2</recv></participantstreamassoc>"
    "<participantstreamassoc participant_id='pA'><send>s2</send><recv>s1</recv></participantstreamassoc></recording>"
)


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(fn(F.col("x")).alias("r")).first().r


def sdp_of(spark, *lines):
    return one(spark, "\r\n".join(("v=0", "o=- 1 1 IN IP4 10.1.1.1", "s=-", "c=IN IP4 10.1.1.1") + lines) + "\r\n", sdp.parse_sdp)


def test_sdp_basic_audio(spark):
    s = sdp_of(spark, "m=audio 30000 RTP/AVP 0 8 101", "a=rtpmap:0 PCMU/8000", "a=rtpmap:8 PCMA/8000", "a=rtpmap:101 telephone-event/8000",
               "a=fmtp:101 0-15", "a=sendrecv", "a=label:1", "a=x-own:z")
    (m,) = s.media
    assert (m.port, m.label, m.direction, m.payload_types) == (30000, "1", "sendrecv", ["0", "8", "101"])
    assert m.rtpmap["8"] == "PCMA/8000" and m.fmtp == {"101": "0-15"} and m.attributes["x-own"] == ["z"]
    assert s.connection_address == "10.1.1.1" and s.origin.endswith("10.1.1.1")


def test_sdp_rtcp_forms(spark):
    s = sdp_of(spark, "m=audio 40000 RTP/AVP 0", "a=rtcp:40002 IN IP4 1.2.3.4", "a=sendonly",
               "m=audio 50000 RTP/AVP 0", "c=IN IP4 10.9.9.9", "a=rtcp-mux", "a=recvonly", "a=mid:audio1", "m=video 30002/2 RTP/AVP 96")
    assert [m.rtcp_port for m in s.media] == [40002, None, None]
    assert s.media[1].rtcp_mux and s.media[1].mid == "audio1" and s.media[1].connection_address == "10.9.9.9"
    df = spark.createDataFrame([(m.port, m.rtcp_port, m.rtcp_mux) for m in s.media], "port int, r int, m boolean")
    assert [r[0] for r in df.select(sc.infer_rtcp_port("port", "r", "m")).collect()] == [40002, 50000, 30003]


def test_sdp_malformed_media_line(spark):
    s = sdp_of(spark, "m=audio", "a=label:9", "c=IN IP4 10.7.7.7", "m=audio 10 RTP/AVP 0", "a=inactive")
    assert len(s.media) == 1 and s.media[0].label is None and s.media[0].direction == "inactive"
    assert s.connection_address == "10.7.7.7"


def test_metadata_wiring(spark):
    m = one(spark, XML, parse_rs_metadata)
    assert m.version == "1" and [p.aor for p in m.participants] == ["sip:b@x.example", "sip:a@x.example"]
    assert [s.label for s in m.streams] == ["96", "97"] and all(s.participant_ids == ["pA", "pB"] for s in m.streams)
    assert m.sessions[0].participant_ids == ["pB"] and m.sessions[0].stream_ids == ["s1", "s2"]


def test_metadata_prefixed_and_old_spellings(spark):
    xml = "<r:recording xmlns:r='urn:ietf:params:xml:ns:recording:1'><r:participant participantid='p1'/><r:stream streamid='q'><r:label> 5 </r:label></r:stream></r:recording>"
    m = one(spark, xml, parse_rs_metadata)
    assert m.version == "1" and m.participants[0].participant_id == "p1" and (m.streams[0].stream_id, m.streams[0].label) == ("q", "5")


def test_metadata_unreadable(spark):
    m = one(spark, "<recording><unclosed", parse_rs_metadata)
    assert m.streams == [] and m.participants == [] and m.sessions == [] and m.raw_xml.startswith("<rec")


def test_metadata_cut_off_keeps_complete_elements(spark):
    xml = "<r:recording xmlns:r='urn:ietf:params:xml:ns:recording:1'><r:participant participant_id='p1'/><r:stream stream_id='s1'><r:label>5</r:label></r:stream><r:stream stream_id='s2'><r:lab"
    m = one(spark, xml, parse_rs_metadata)
    assert [(s.stream_id, s.label) for s in m.streams] == [("s1", "5")] and [p.participant_id for p in m.participants] == ["p1"] and m.raw_xml == xml
    broken = "<recording><stream stream_id='a'><label>1</label></stream><session session_id='x'></recording>"
    assert [s.stream_id for s in one(spark, broken, parse_rs_metadata).streams] == ["a"]


def test_first_metadata_part_with_a_root_counts(spark):
    part = "Content-Type: application/rs-metadata+xml\r\n\r\n"
    body = f"--u\r\n{part}no xml\r\n--u\r\n{part}{XML}\r\n--u--\r\n"
    df = spark.createDataFrame([(body, "multipart/mixed;boundary=u", "")], "b string, c string, h string")
    assert len(df.select(parse_rs_metadata(metadata_xml(F.col("b"), F.col("c"), F.col("h"))).alias("m")).first().m.streams) == 2
    cut = XML[: XML.rindex("</")]
    df = spark.createDataFrame([("nothing", "text/x", "A: b\n" + cut)], "b string, c string, h string")
    assert len(df.select(parse_rs_metadata(metadata_xml(F.col("b"), F.col("c"), F.col("h"))).alias("m")).first().m.streams) == 2


def test_boundary_after_a_long_preamble(spark):
    body = "p" * 600 + "\r\n--u-1\r\nContent-Type: application/sdp\r\n\r\nv=0\r\n--u-1--\r\n"
    df = spark.createDataFrame([(body, "x/y")], "b string, c string")
    parts = df.select(text.body_parts(F.col("b"), F.col("c")).alias("p")).first().p
    assert [p.content for p in parts if p.content_type == "application/sdp"] == ["v=0"]


def test_long_hexadecimal_numbers(spark):
    texts = ["0x0000000000000001", "0x7fffffffffffffff", "0x8000000000000000", "0x" + "0" * 40 + "ff", "0x" + "f" * 20, "0x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(sc.parse_int("t").alias("n")).collect()] == [1, (1 << 63) - 1, None, 255, None, None]


@pytest.mark.parametrize("form", ["plain", "hex", "sniffed", "salvaged-hex", "headers"])
def test_metadata_is_found(spark, form):
    parts = f"--u-1\r\nContent-Type: application/sdp\r\n\r\nv=0\r\n--u-1\r\nContent-Type: application/rs-metadata+xml\r\n\r\n{XML}\r\n--u-1--\r\n"
    body, ctype, head = {
        "plain": (parts, 'multipart/mixed;boundary="u-1"', ""),
        "hex": (parts.encode().hex(), "multipart/mixed;boundary=u-1", ""),
        "sniffed": (parts, "multipart/mixed", ""),
        "salvaged-hex": (XML.encode().hex(), "text/x", ""),
        "headers": ("nothing", "text/x", "A: b\n" + XML),
    }[form]
    df = spark.createDataFrame([(body, ctype, head)], "b string, c string, h string")
    m = df.select(parse_rs_metadata(metadata_xml(F.col("b"), F.col("c"), F.col("h"))).alias("m")).first().m
    assert {s.label for s in m.streams} == {"96", "97"}


def test_sip_text(spark):
    raw = "INVITE sip:bob@x SIP/2.0\r\nv: SIP/2.0/UDP 10.0.0.1:5060;branch=z9hG4bK77\r\ni: abc@h\r\nf: <sip:a@b>\r\nCSeq: 7 INVITE\r\nc: text/x\r\n\r\nhello\r\n"
    r = one(spark, raw, text.parse_sip_text)
    assert (r.method, r.call_id, r.cseq, r.from_header, r.content_type) == ("INVITE", "abc@h", "7 INVITE", "<sip:a@b>", "text/x")
    assert (r.via_branch, r.via_sent_by, r.body, r.error) == ("z9hG4bK77", "10.0.0.1:5060", "hello\n", None)
    r = one(spark, "SIP/2.0 486 Busy Here\r\nCall-ID: q\r\n\r\n", text.parse_sip_text)
    assert (r.status_code, r.reason_phrase, r.call_id, r.body) == (486, "Busy Here", "q", None)
    assert one(spark, "garbage", text.parse_sip_text).error and one(spark, " ", text.parse_sip_text).error


def test_hex_body_rules(spark):
    assert one(spark, "48656c6c6f21", text.maybe_hex_decode) == "Hello!"
    assert one(spark, "48:65:6c:6c:6f:21", text.maybe_hex_decode) == "Hello!"
    assert one(spark, "48656c6", text.maybe_hex_decode) == "48656c6"
    assert one(spark, "0102030405060708", text.maybe_hex_decode) == "0102030405060708"
    assert one(spark, "c3a9c3a9c3a9", text.maybe_hex_decode) == "ééé"
    assert one(spark, "e9e9e9e9", text.maybe_hex_decode) == "éééé"


def test_numbers(spark):
    rows = [("0x1F", 31), ("31", 31), (" -4 ", -4), ("", None), ("1.5", None), ("0xZZ", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, n bigint")
    assert df.where(~sc.parse_int("t").eqNullSafe(F.col("n"))).count() == 0


def test_round_exact_matches_python(spark):
    import random

    rng = random.Random(4)
    values = [2.675, 0.125, 1.005, 0.25, 1.05, 2.5, 3.5, -1.25, 0.15, 1e6 + 0.005] + [rng.randrange(100000) / 1000 for _ in range(3000)]
    df = spark.createDataFrame([(v, round(v, 2), f"{v:.1f}") for v in values], "v double, r double, s string")
    bad = df.where((sc.round_exact("v", 2) != F.col("r")) | (sc.one_decimal("v") != F.col("s"))).collect()
    assert bad == []


def test_display_helpers(spark):
    df = spark.createDataFrame([("Al", "sip:al@x"), (None, "tel:55"), ("Z", None), ("", "bo@x")], "n string, a string")
    assert [r[0] for r in df.select(sc.participant_text("n", "a")).collect()] == ["Al (al)", "55", "Z", "bo"]
    df = spark.createDataFrame([(3723.0456,), (-1.0,), (None,)], "s double")
    assert [r[0] for r in df.select(sc.format_duration("s")).collect()] == ["01:02:03.046", "unknown", "unknown"]
    df = spark.createDataFrame([(1700000000.25,)], "e double")
    assert df.select(sc.epoch_to_utc("e"), sc.epoch_to_utc("e", 3), sc.utc_day("e")).first()[:] == (
        "2023-11-14T22:13:20.250000Z", "2023-11-14T22:13:20.250Z", "2023-11-14",
    )
    info = one(spark, "Packet size limit: file hdr: 96 bytes (truncated)\nNumber of dropped packets: 12\n", sc.parse_capture_info)
    assert (info.snaplen, info.truncated, info.drops) == (96, True, 12)


def test_metadata_with_long_lead(spark):
    """Blanks, comments and instructions before the root, thousands of them, don't fill the stack."""
    for lead in (" " * 300_000, "<!-- c --> " * 30_000, "<?pi x?>\n" * 30_000):
        parsed = one(spark, lead + XML[XML.index("<recording"):], parse_rs_metadata)
        assert parsed.version == "1" and len(parsed.participants) == 2
