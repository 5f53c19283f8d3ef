"""Registered queries for column functions, detectors and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import scalars as sc
from ..functions import sdp as sdp_fn
from ..functions import text as tx
from ..functions.rs_metadata import metadata_xml, parse_rs_metadata
from ..operators import detectors, lifecycle, messages as msg, report, rtcp, sip, streams, timeline
from . import driver_oracle as o
from .driver_queries import (
    BUCKET_S, CHUNK, MIN_PACKETS, _MD_BASE, _analysis, _bound, _changes, _counts, _holds, _lifecycles, _members, _metadata_xml,
    _rtcp, _samples, _streams, detector, query,
)
from .driver_views import DriverViews

CRLF = "\r\n"
_EV = "(select event_id, user_id, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events)"


def _ev(v: DriverViews):
    return v.table("events").select(
        "event_id", "user_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k")
    )


def _s(c: str):
    return F.col(c).cast("string")


# --- 2.8 scalar functions ---------------------------------------------------------------------------


@query(
    "fn1_parse_int",
    f"""select event_id, case k % 6 when 0 then event_id when 1 then event_id when 2 then -event_id when 3 then event_id else -777 end as n from {_EV}""",
)
def _(v):
    k = F.col("k") % 6
    text = (
        F.when(k == 0, _s("event_id")).when(k == 1, F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("event_id")), 24, "0"))).when(k == 2, F.concat(F.lit(" -"), _s("event_id"), F.lit(" ")))
        .when(k == 3, F.concat(F.lit("0X"), F.hex("event_id"))).when(k == 4, F.concat(_s("event_id"), F.lit(".5"))).otherwise("")
    )
    return _ev(v).select("event_id", F.coalesce(sc.parse_int(text), F.lit(-777)).alias("n"))


@query("fn2_parse_float", f"select event_id, case when k % 4 < 3 then value else -777.0::double end as x from {_EV}")
def _(v):
    k = F.col("k") % 4
    text = F.when(k == 0, _s("value")).when(k == 1, F.concat(F.lit(" "), _s("value"))).when(k == 2, F.concat(_s("value"), F.lit("e0"))).otherwise(F.concat(_s("value"), F.lit("d")))
    return _ev(v).select("event_id", F.coalesce(sc.parse_float(text), F.lit(-777.0)).alias("x"))


@query(
    "fn3_ssrc_hex",
    f"""select event_id, case when k % 9 = 0 then '?' else concat('0x', printf('%08x', event_id * 400001 % 4294967296)) end as h from {_EV}""",
)
def _(v):
    n = F.when(F.col("k") % 9 != 0, F.col("event_id") * 400001 % 4294967296)
    return _ev(v).select("event_id", sc.ssrc_hex(n).alias("h"))


@query("fn4_flow_key", "select frame_number, concat(src_ip, ':', src_port, '->', dst_ip, ':', dst_port) as flow_key from pk", "pk")
def _(v):
    return v.packets().select("frame_number", sc.flow_key("src_ip", "src_port", "dst_ip", "dst_port").alias("flow_key"))


@query(
    "fn5_split_ints",
    f"""select event_id, case when k % 5 = 0 then 0 when k % 5 = 1 then 2 else 3 end as n, case when k % 5 = 0 then 0 when k % 5 = 1 then event_id + k else event_id + 255 end as total from {_EV}""",
)
def _(v):
    k = F.col("k") % 5
    text = F.when(k == 0, "").when(k == 1, F.concat(_s("event_id"), F.lit(", "), _s("k"))).otherwise(F.concat(_s("event_id"), F.lit(",0xff , zz")))
    xs = sc.split_ints(text)
    total = F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return _ev(v).select("event_id", F.size(xs).alias("n"), total.alias("total"))


@query(
    "fn6_report_blocks",
    """select call_id, frame_number, block, coalesce(ssrc, -1) as ssrc, coalesce(fraction, -1) as fraction, coalesce(cumulative, -1) as cumulative, coalesce(jitter, -1) as jitter
       from blk where ssrc is not null or fraction is not null or jitter is not null""",
    "blk",
)
def _(v):
    return rtcp.report_blocks(_rtcp(v)).select(
        "call_id", "frame_number", "block", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("ssrc", "fraction", "cumulative", "jitter")]
    )


@query(
    "fn7_infer_rtcp_port",
    "select call_id, msg_idx, media_idx, coalesce(rtcp_port, case when rtcp_mux then port when port <> 0 then port + 1 end, -1) as rtcp from media", "media",
)
def _(v):
    return msg.sdp_media(v.messages()).select(
        "call_id", "msg_idx", "media_idx", F.coalesce(sc.infer_rtcp_port("port", "rtcp_port", "rtcp_mux"), F.lit(-1)).alias("rtcp")
    )


_R = "93.2::double - (0.024::double * d + case when d > 177.3 then 0.11::double * (d - 177.3::double) else 0::double end) - (ie + (95.0::double - ie) * (loss / (loss + 25.1::double)))"
_RSRC = f"(select event_id, k::double as loss, value * 3.0::double as d, (k % 4) * 5.0::double as ie from {_EV})"


def _r_rows(v):
    e = _ev(v).select("event_id", F.col("k").cast("double").alias("loss"), (F.col("value") * F.lit(3.0)).alias("d"), ((F.col("k") % 4) * F.lit(5.0)).alias("ie"))
    return e.withColumn("r", q.r_factor(F.col("loss"), F.col("d"), F.col("ie"), F.lit(25.1)))


@query("fn8_r_factor", f"select event_id, round({_R}, 9) as r from {_RSRC}")
def _(v):
    return _r_rows(v).select("event_id", F.round("r", 9).alias("r"))


@query(
    "fn9_r_to_mos",
    f"""select event_id, case when r <= 0 then 1.0::double when r >= 100 then 4.5::double else greatest(1.0::double, least(4.5::double, cast(printf('%.2f', 1.0::double + 0.035::double * r
        + 7e-6::double * r * (r - 60.0::double) * (100.0::double - r)) as double))) end as mos from (select event_id, {_R} as r from {_RSRC})""",
)
def _(v):
    return _r_rows(v).select("event_id", q.r_to_mos(F.col("r")).alias("mos"))


@query(
    "fn10_codec_table",
    f"""select event_id, coalesce(codec, 'dynamic') as codec, coalesce(clock_hz, 8000) as clock_hz, coalesce(ie, 0.0)::double as ie, coalesce(bpl, 25.1)::double as bpl from {_EV} e
        left join (values (0, 'PCMU (G.711u)', 8000, 0.0, 25.1), (8, 'PCMA (G.711a)', 8000, 0.0, 25.1), (9, 'G.722', 16000, 13.0, 18.0), (18, 'G.729', 8000, 11.0, 19.0),
                          (4, 'G.723.1', 8000, 15.0, 16.1), (3, 'GSM', 8000, 20.0, 10.0), (15, 'G.728', 8000, 7.0, 19.0)) t(pt, codec, clock_hz, ie, bpl) on t.pt = e.k % 25""",
)
def _(v):
    return _ev(v).withColumn("c", q.codec_for(F.col("k") % 25)).select("event_id", "c.codec", "c.clock_hz", "c.ie", "c.bpl")


@query("fn11_mos_sample", "select call_id, frame_number, block, mos, r_factor, loss_pct, jitter_ms, codec from smp", "smp")
def _(v):
    return _samples(v).select("call_id", "frame_number", "block", "mos", "r_factor", "loss_pct", "jitter_ms", "codec")


@query(
    "fn12_content_type",
    f"""select event_id, case k % 5 when 0 then 'application/rs-metadata+xml' when 1 then 'application/rs-metadata' when 2 then 'text/plain' when 3 then 'application/sdp' else '' end as base,
               k % 5 < 2 as is_md, case when k % 5 < 2 then 'application/rs-metadata+xml' when k % 5 = 2 then concat(' Text/Plain ;q=', k) when k % 5 = 3 then 'application/SDP' else '' end as normal from {_EV}""",
)
def _(v):
    k = F.col("k") % 5
    ct = (
        F.when(k == 0, F.concat(F.lit(" Application/RS-Metadata+XML; v="), _s("k"))).when(k == 1, "application/rs-metadata").when(k == 2, F.concat(F.lit(" Text/Plain ;q="), _s("k")))
        .when(k == 3, "application/SDP").otherwise("")
    )
    return _ev(v).select("event_id", tx.content_type_base(ct).alias("base"), tx.is_rs_metadata(ct).alias("is_md"), tx.normalize_content_type(ct).alias("normal"))


@query(
    "fn13_boundary",
    f"""select event_id, case when k % 3 < 2 then concat('b-', event_id) else '-' end as from_header, concat('s=', event_id) as sniffed from {_EV}""",
)
def _(v):
    k = F.col("k") % 3
    b = F.concat(F.lit("b-"), _s("event_id"))
    ct = F.when(k == 0, F.concat(F.lit('multipart/mixed; Boundary="'), b, F.lit('"; x=1'))).when(k == 1, F.concat(F.lit("multipart/mixed;boundary="), b)).otherwise("multipart/mixed")
    body = F.concat(F.lit("text -- not one\n--s="), _s("event_id"), F.lit("\r\nContent-Type: a/b\r\n"))
    return _ev(v).select("event_id", F.coalesce(tx.header_boundary(ct), F.lit("-")).alias("from_header"), tx.sniffed_boundary(body).alias("sniffed"))


@query(
    "fn14_hex_bodies",
    """select conv_id, turn, case when octet_length(encode(text)) < 4 then lower(hex(encode(text))) else text end as decoded, text as kept from conversations""",
)
def _(v):
    hexed = F.lower(F.hex(F.encode("text", "UTF-8")))
    return v.table("conversations").select("conv_id", "turn", tx.maybe_hex_decode(hexed).alias("decoded"), tx.maybe_hex_decode("text").alias("kept"))


_UNIX = "trim(replace({0}, chr(13) || chr(10), chr(10)), chr(10))"


@query(
    "fn15_body_parts",
    f"""select d.doc_id, p.pos, p.ct as content_type, {_UNIX.format("case when p.pos = 0 then d.text else d.lang end")} as content
        from documents d, (values (0, 'text/plain'), (1, 'x/lang')) p(pos, ct)""",
)
def _(v):
    d = v.table("documents")
    mark = F.concat(F.lit("zq7-"), _s("doc_id"), F.lit("-edge"))
    body = F.concat(
        F.lit("--"), mark, F.lit(f"{CRLF}X-A: 1{CRLF}Content-Type: a/b{CRLF}content-type: text/plain{CRLF}{CRLF}"), F.col("text"),
        F.lit(f"{CRLF}--"), mark, F.lit(f"{CRLF}Content-Type: x/lang{CRLF}{CRLF}"), F.col("lang"), F.lit(f"{CRLF}--"), mark, F.lit(f"--{CRLF}"),
    )
    ct = F.concat(F.lit('multipart/mixed;boundary="'), mark, F.lit('"'))
    return d.select("doc_id", F.posexplode(tx.body_parts(body, ct)).alias("pos", "p")).select("doc_id", "pos", "p.content_type", "p.content")


def _sdp_text(v: DriverViews, eol: str = CRLF):
    """SDP text of every message with media, from the view's columns."""

    def line(i: int):
        rtcp = F.when(F.col("rtcp_port0").isNotNull(), F.concat(F.lit(f"{eol}a=rtcp:"), _s("rtcp_port0"), F.lit(" IN IP4 1.2.3.4"))).otherwise("") if i == 0 else F.lit("")
        return F.concat(
            F.lit("m="), F.lit("audio") if i == 0 else F.col("type1"), F.lit(" "), _s(f"port{i}"), F.lit(" RTP/AVP "), F.col("pts"),
            F.lit(f"{eol}a=rtpmap:0 PCMU/8000{eol}a=fmtp:101 0-15"), rtcp,
            F.when(F.col("mux"), f"{eol}a=rtcp-mux").otherwise(""),
            F.when(F.col(f"label{i}").isNotNull(), F.concat(F.lit(f"{eol}a=label:"), F.col(f"label{i}"))).otherwise(""),
            F.lit(f"{eol}a=mid:m{i}"),
            F.when(F.col(f"dir{i}").isNotNull(), F.concat(F.lit(f"{eol}a="), F.col(f"dir{i}"))).otherwise(""),
            F.lit(f"{eol}"),
        )

    head = F.concat(F.lit(f"v=0{eol}o="), F.col("sdp_origin"), F.lit(f"{eol}s=-{eol}c=IN IP4 10.8.0.1{eol}a=ignored{eol}"))
    broken = F.when(F.col("k") % 7 == 3, f"m=broken{eol}a=label:x{eol}c=IN IP4 10.8.0.2{eol}").otherwise("")
    second = F.when(F.col("c") % 9 != 8, line(1)).otherwise("")
    return F.concat(head, line(0), broken, second)


def _message_texts(v: DriverViews):
    """Whole SIP messages as text: headers, SDP and metadata parts."""
    m = v.view("sip").withColumn("sdp_text", F.when(F.col("has_sdp"), _sdp_text(v)))
    start = F.when(F.col("method").isNotNull(), F.concat("method", F.lit(" sip:rec@b.example SIP/2.0"))).otherwise(
        F.concat(F.lit("SIP/2.0 "), _s("status_code"), F.lit(" "), F.coalesce("reason_phrase", F.lit("")))
    )
    short = F.col("k") % 2 == 0

    def header(long: str, compact: str | None, c):
        name = F.when(short, F.lit(compact)).otherwise(F.lit(long)) if compact else F.lit(long)
        return F.when(c.isNotNull() & (c != ""), F.concat(name, F.lit(": "), c, F.lit(CRLF))).otherwise("")

    xml = F.concat(
        F.lit('<recording xmlns="urn:ietf:params:xml:ns:recording:1"><session session_id="X"/><stream stream_id="S'), _s("c"),
        F.lit('"><label>0</label></stream></recording>'),
    )
    part = lambda ct, content: F.concat(F.lit(f"--edge{CRLF}Content-Type: {ct}{CRLF}{CRLF}"), content, F.lit(CRLF))
    body = F.when(
        F.col("has_metadata_body"),
        F.concat(F.when(F.col("has_sdp"), part("application/sdp", F.col("sdp_text"))).otherwise(""), part("application/rs-metadata+xml", xml), F.lit(f"--edge--{CRLF}")),
    ).otherwise(F.col("sdp_text"))
    ct = F.when(F.col("has_metadata_body"), "multipart/mixed;boundary=edge").otherwise(F.when(F.col("has_sdp"), "application/sdp"))
    hexed = F.when(F.col("k") % 10 == 0, F.lower(F.hex(F.encode(body, "UTF-8")))).otherwise(body)
    text = F.concat(
        start, F.lit(CRLF), header("Via", "v", F.concat(F.lit("SIP/2.0/UDP "), "via_sent_by", F.lit(";rport;branch="), "via_branch")),
        header("From", "f", F.col("from_header")), header("To", "t", F.col("to_header")), header("Call-ID", "i", F.col("call_id")), header("CSeq", None, F.col("cseq")),
        header("Contact", "m", F.col("contact")), header("User-Agent", None, F.col("user_agent")), header("Server", None, F.col("server")),
        header("Content-Type", "c", ct), F.lit(CRLF), F.coalesce(hexed, F.lit("")),
    )
    return m.withColumn("text", text).withColumn("ct", ct).withColumn("hexed", hexed)


@query(
    "fn16_parse_sip_text",
    """select frame_number, call_id, coalesce(method, '-') as method, coalesce(status_code, -1) as status_code, coalesce(reason_phrase, '-') as reason_phrase, cseq, from_header, to_header,
              coalesce(contact, '-') as contact, case when has_metadata_body then 'multipart/mixed;boundary=edge' when has_sdp then 'application/sdp' else '-' end as content_type,
              coalesce(user_agent, '-') as user_agent, coalesce(nullif(server, ''), '-') as server, via_branch, via_sent_by, has_sdp or has_metadata_body as has_body from sip""",
    "sip",
)
def _(v):
    m = _message_texts(v).select("frame_number", tx.parse_sip_text("text").alias("s"))
    dash = lambda c: F.coalesce(f"s.{c}", F.lit("-")).alias(c)
    return m.select(
        "frame_number", "s.call_id", dash("method"), F.coalesce("s.status_code", F.lit(-1)).alias("status_code"), dash("reason_phrase"), "s.cseq", "s.from_header",
        "s.to_header", dash("contact"), dash("content_type"), dash("user_agent"), dash("server"), "s.via_branch", "s.via_sent_by", F.col("s.body").isNotNull().alias("has_body"),
    )


@query("fn17_via", "select frame_number, via_branch, via_sent_by from sip", "sip")
def _(v):
    via = F.concat(F.lit("SIP/2.0/UDP  "), "via_sent_by", F.lit(";rport;Branch="), "via_branch", F.lit(", SIP/2.0/UDP 9.9.9.9;branch=x"))
    return v.view("sip").select("frame_number", sc.via_branch(via).alias("via_branch"), sc.via_sent_by(via).alias("via_sent_by"))


_MEDIA_SQL = """select call_id, msg_idx, media_idx, media_type, port, pts, coalesce(direction, '-') as direction, coalesce(label, '-') as label, mid, coalesce(rtcp_port, -1) as rtcp_port, rtcp_mux,
       '10.8.0.' || case when k % 7 = 3 then '2' else '1' end as session_address, sdp_origin as origin from media join (select call_id, msg_idx, k, sdp_origin from sip) using (call_id, msg_idx)"""


@query("fn18_parse_sdp", _MEDIA_SQL, "media", "sip")
def _(v):
    m = v.view("sip").where("has_sdp").withColumn("s", sdp_fn.parse_sdp(_sdp_text(v)))
    rows = m.select("call_id", "msg_idx", "s.connection_address", "s.origin", F.explode("s.media").alias("m"))
    return rows.select(
        "call_id", "msg_idx", F.col("m.media_idx").alias("media_idx"), "m.media_type", "m.port", F.array_join("m.payload_types", " ").alias("pts"),
        F.coalesce("m.direction", F.lit("-")).alias("direction"), F.coalesce("m.label", F.lit("-")).alias("label"), "m.mid",
        F.coalesce("m.rtcp_port", F.lit(-1)).alias("rtcp_port"), "m.rtcp_mux", F.col("connection_address").alias("session_address"), "origin",
    )


@query(
    "fn19_parse_rs_metadata",
    f"""select c_custkey, case when c_custkey % 3 < 2 then '1' else '-' end as version, concat('p', c_custkey) as participant_id, c_name as name, concat('sip:c', c_custkey, '@bank') as aor,
               cast(n as varchar) as label, concat('s', lo) as stream_id, concat('s', hi, 'b') as second_id, concat('X', c_nationkey) as session_id,
               concat('p', c_custkey) as members, concat('s', lo) as session_streams from {_MD_BASE}""",
)
def _(v):
    m = _metadata_xml(v).withColumn("m", parse_rs_metadata("xml"))
    p, s, x = F.col("m.participants")[0], F.col("m.streams"), F.col("m.sessions")[0]
    return m.select(
        "c_custkey", F.coalesce("m.version", F.lit("-")).alias("version"), p["participant_id"].alias("participant_id"), p["name"].alias("name"), p["aor"].alias("aor"),
        s[0]["label"].alias("label"), s[0]["stream_id"].alias("stream_id"), s[1]["stream_id"].alias("second_id"), x["session_id"].alias("session_id"),
        F.array_join(x["participant_ids"], ",").alias("members"), F.array_join(x["stream_ids"], ",").alias("session_streams"),
    )


@query("fn20_extract_metadata", f"select c_custkey, concat('s', lo) as stream_id from {_MD_BASE}")
def _(v):
    """Metadata in its own part, in a hex body, and in text without any type."""
    m = _metadata_xml(v)
    k = F.col("c_custkey") % 3
    doc = F.regexp_replace("xml", r"^<\?.*?\?>\n", "")
    body = F.when(k == 0, F.concat(F.lit(f"--q1{CRLF}Content-Type: application/rs-metadata{CRLF}{CRLF}"), doc, F.lit(f"{CRLF}--q1--{CRLF}"))).when(
        k == 1, F.hex(F.encode(F.concat(F.lit("garbled start "), doc), "UTF-8"))
    ).otherwise("nothing here")
    headers = F.when(k == 2, F.concat(F.lit("X-Copy: "), doc)).otherwise("")
    ct = F.when(k == 0, "multipart/mixed;boundary=q1").otherwise("text/plain")
    out = m.select("c_custkey", parse_rs_metadata(metadata_xml(body, ct, headers)).alias("m"))
    return out.select("c_custkey", F.col("m.streams")[0]["stream_id"].alias("stream_id"))


@query(
    "fn21_enrich_message",
    """select s.call_id, s.frame_number, s.has_sdp, s.has_metadata_body, coalesce(m.n, 0) as n_media, coalesce(m.ports, '') as ports,
              case when s.has_metadata_body then concat('S', s.c) else '-' end as stream_id
       from sip s left join (select call_id, msg_idx, count(*) as n, string_agg(port, ',' order by media_idx) as ports from media group by all) m using (call_id, msg_idx)""",
    "sip", "media",
)
def _(v):
    raw = _message_texts(v).select("file_idx", "frame_number", "t_rel", "ts_epoch", tx.parse_sip_text("text").alias("s"))
    e = msg.enrich_messages(raw.select("file_idx", "frame_number", "t_rel", "ts_epoch", "s.*").drop("error"))
    return e.select(
        "call_id", "frame_number", "has_sdp", "has_metadata_body",
        F.when(F.col("media").isNull(), 0).otherwise(F.size("media")).cast("bigint").alias("n_media"),
        F.coalesce(F.array_join(F.transform("media", lambda m: m["port"].cast("string")), ","), F.lit("")).alias("ports"),
        F.coalesce(F.try_element_at("metadata.streams", F.lit(1))["stream_id"], F.lit("-")).alias("stream_id"),
    )


@query(
    "fn22_contact_and_origin",
    "select frame_number, coalesce(regexp_extract(contact, '@([^>;]+)', 1), '-') as host, coalesce(split_part(sdp_origin, ' ', 6), '-') as origin from sip", "sip",
)
def _(v):
    return v.messages().select(
        "frame_number", F.coalesce(sc.contact_host("contact"), F.lit("-")).alias("host"), F.coalesce(sc.sdp_origin_address("sdp_origin"), F.lit("-")).alias("origin")
    )


@query("fn23_aor_from_header", "select frame_number, concat('sip:u', c, '@a.example') as sender, concat('SIP:rec', k % 3, '@b.example') as receiver from sip", "sip")
def _(v):
    return v.messages().select("frame_number", sc.aor_from_header("from_header").alias("sender"), sc.aor_from_header("to_header").alias("receiver"))


@query("fn24_epoch_to_utc", "select event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 'Z') as micros, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 'Z') as millis, strftime(ts, '%Y-%m-%d') as day from events")
def _(v):
    e = v.view("ev")
    return e.select(
        F.col("frame_number").alias("event_id"), sc.epoch_to_utc("ts_epoch").alias("micros"), sc.epoch_to_utc("ts_epoch", 3).alias("millis"), sc.utc_day("ts_epoch").alias("day")
    )


@query(
    "fn25_format_duration",
    """select event_id, case when s is null or s < 0 then 'unknown' else printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) end as text
       from (select *, cast(round_even(s * 1000.0::double, 0) as bigint) as ms from (select event_id, case when k % 10 = 0 then null when k % 10 = 1 then -value else value * k end as s from """ + _EV + "))",
)
def _(v):
    k = F.col("k") % 10
    s = F.when(k == 0, F.lit(None)).when(k == 1, -F.col("value")).otherwise(F.col("value") * F.col("k"))
    return _ev(v).select("event_id", sc.format_duration(s).alias("text"))


@query(
    "fn26_endpoint_text",
    f"select event_id, case k % 4 when 0 then concat('10.0.0.', user_id, ':', event_id) when 1 then concat('10.0.0.', user_id) when 2 then concat('unknown:', event_id) else 'unknown' end as text from {_EV}",
)
def _(v):
    k = F.col("k") % 4
    ip = F.when(k < 2, F.concat(F.lit("10.0.0."), _s("user_id"))).when(k == 2, "")
    port = F.when(k.isin(0, 2), F.col("event_id"))
    return _ev(v).select("event_id", sc.endpoint_text(ip, port).alias("text"))


@query(
    "fn27_failure_hint",
    f"""select event_id, coalesce(hint, '-') as hint from {_EV} e left join (values (408, 'Request Timeout — no timely response from the peer.'), (481, 'Call/Transaction Does Not Exist — dialog state mismatch.'),
        (488, 'Not Acceptable Here — typically a codec mismatch.'), (491, 'Request Pending — competing re-INVITEs (glare).'), (500, 'Server Internal Error.'),
        (503, 'Service Unavailable — peer overloaded or marked down.'), (606, 'Not Acceptable — media negotiation failure.')) h(code, hint) on h.code = 400 + e.event_id % 210""",
)
def _(v):
    return _ev(v).select("event_id", F.coalesce(sc.failure_hint(F.lit(400) + F.col("event_id") % 210), F.lit("-")).alias("hint"))


@query("fn28_case_dir_name", "select event_id, concat('id', event_id, '_at_host', user_id, '_x') as name from events")
def _(v):
    return _ev(v).select("event_id", sc.case_dir_name(F.concat(F.lit("id"), _s("event_id"), F.lit("@host"), _s("user_id"), F.lit("/x"))).alias("name"))


@query("fn29_stream_label", "select call_id, stream_idx, sname as name from bh", "bh")
def _(v):
    return _bound(v).select("call_id", "stream_idx", sc.stream_label("matched_siprec_stream_id", "ssrc", "dst_ip", "dst_port").alias("name"))


@query(
    "fn30_parse_capture_info",
    f"select event_id, case when k % 3 < 2 then event_id else -1 end as snaplen, k % 3 = 1 as truncated, case when k % 2 = 0 then k else -1 end as drops from {_EV}",
)
def _(v):
    text = F.concat(
        F.lit("File name: x 7.pcap\n"), F.when(F.col("k") % 3 < 2, F.concat(F.lit("Packet size limit: file hdr: "), _s("event_id"), F.lit(" bytes"))).otherwise("No limit here: 9"),
        F.when(F.col("k") % 3 == 1, " (truncated)").otherwise(""), F.lit("\r\n"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("Number of dropped packets: "), _s("k"))).otherwise("Number of packets: 5"),
    )
    i = sc.parse_capture_info(text)
    return _ev(v).select("event_id", F.coalesce(i["snaplen"], F.lit(-1)).alias("snaplen"), i["truncated"].alias("truncated"), F.coalesce(i["drops"], F.lit(-1)).alias("drops"))


# --- 2.9 detectors -------------------------------------------------------------------------------------


def _evidence(v):
    return detectors.grouped_evidence(v.messages(), _members(v), _holds(v))


@detector("det1_gaps", "d_none", "d_seq", "d_nortcp", "d_late", "d_early")
def _(v):
    m = v.messages()
    return detectors.detect_gaps(_bound(v), _counts(v), timeline.timeline_scalars(m), timeline.hold_windows(m, CHUNK), BUCKET_S)


@detector("det2_stream_counts", "d_mix1", "d_mix2", "d_mix3", "d_mix4", "d_mix5")
def _(v):
    return detectors.detect_stream_counts(_counts(v))


@detector("det3_consistency", "d_cmr", "d_cms", "d_csr")
def _(v):
    return detectors.detect_consistency(_counts(v))


@detector("det4_bursts", "d_burst")
def _(v):
    return detectors.detect_bursts(_members(v)), _evidence(v)


@detector("det5_sip_timing", "d_rx", "d_fail", "d_noack", "d_slow", "d_timer")
def _(v):
    return detectors.detect_sip_timing(v.messages()), _evidence(v)


@detector("det6_compliance", "d_nomd", "d_mdinv", "d_mdinc", "d_same", "d_dir")
def _(v):
    return detectors.detect_compliance(v.messages(), v.snapshots())


o._block(
    "ctpart", ["inv", "snap"],
    """select call_id, frame_number, p.pos as pos, p.ct as ct from inv, (values (0, 'application/sdp'), (1, 'Application/RS-Metadata')) p(pos, ct) where call_id in (select call_id from snap)""",
)
o._rule(
    "d_ct", ["ctpart"], "ctpart where lower(ct) like '%rs-metadata%' and lower(ct) not like '%+xml%'", 101, "SIPREC_BAD_CONTENT_TYPE", "WARN", "Non-standard metadata Content-Type",
    "=concat('Metadata part declared Content-Type ''', ct, '''; expected application/rs-metadata+xml.')", "SBC", "RFC 7865 §6", frames="[frame_number]", sub="pos",
)


@detector("det6_content_type", "d_ct")
def _(v):
    """The same messages with a two-part body whose metadata part has an old type."""
    body = F.concat(
        F.lit(f"--w{CRLF}Content-Type: application/sdp{CRLF}{CRLF}v=0{CRLF}--w{CRLF}Content-Type: Application/RS-Metadata{CRLF}{CRLF}<x n='"), _s("frame_number"), F.lit(f"'/>{CRLF}--w--{CRLF}")
    )
    m = v.messages().withColumn("body", body).withColumn("content_type", F.lit("multipart/mixed;boundary=w"))
    return [d.where("code = 'SIPREC_BAD_CONTENT_TYPE'") for d in detectors.detect_compliance(m, v.snapshots())]


@detector("det7_error_origin", "d_eo", "d_bo")
def _(v):
    return detectors.detect_origins(v.messages())


@detector("det8_ssrc_changes", "d_ssrc")
def _(v):
    return detectors.detect_ssrc_changes(_changes(v), _streams(v), MIN_PACKETS)


@detector("det9_rtcp", "d_loss", "d_rgap", "d_rbye", "d_norep")
def _(v):
    rows = _rtcp(v)
    return [*detectors.detect_rtcp_quality(rtcp.rtcp_stats(rows, BUCKET_S)), detectors.detect_rtcp_presence(rtcp.rtcp_summary(rows))]


@detector("det10_mos", "d_mos")
def _(v):
    return detectors.detect_mos(rtcp.mos_estimates(_samples(v)))


@detector("det11_lifecycle", "d_gap", "d_col", "d_churn", "d_bchurn")
def _(v):
    s, lc = _lifecycles(v)
    members = _members(v)
    bursts = sip.bursts(members)
    gaps = lifecycle.coverage_gaps(s, _holds(v), lc)
    return [
        *detectors.detect_lifecycle(gaps, lifecycle.ssrc_collisions(s, lc, BUCKET_S), lc, s),
        detectors.detect_burst_churn(bursts, lifecycle.burst_ssrc_effects(bursts, s, lc), members),
    ], _evidence(v)


@detector("det12_hold_retrieve", "d_hold")
def _(v):
    return detectors.detect_hold_retrieve(_holds(v)), _evidence(v)


@detector("det13_labels", "d_label")
def _(v):
    return detectors.detect_unbound_labels(v.rs_streams(), _bound(v))


o._block(
    "capq", ["sip0"],
    """select call_id, bool_or(k % 3 = 1) as truncated, max(k) filter (k % 3 = 1) as snaplen, cast(sum(case when k > 97 then 1 else 0 end) as bigint) as drop_count from sip0 group by call_id""",
)
o._rule("d_cut", ["capq"], "capq where truncated", 150, "CAP_TRUNCATED", "WARN", "Capture is snaplen-truncated", "=concat('Packets were captured with a snaplen of ', snaplen, '; payloads may be incomplete.')", "CAPTURE")
o._rule("d_drop", ["capq"], "capq where drop_count > 0", 151, "CAP_DROPS", "WARN", "Capture reported dropped packets",
        "=concat(drop_count, ' packet(s) were dropped during capture — gaps may be capture artifacts, not network loss.')", "CAPTURE")


@detector("det14_capture", "d_cut", "d_drop")
def _(v):
    cut = F.col("k") % 3 == 1
    quality = v.view("sip0").groupBy("call_id").agg(
        F.bool_or(cut).alias("truncated"), F.max(F.when(cut, F.col("k"))).alias("snaplen"), F.count_if(F.expr("k > 97")).alias("drop_count")
    )
    return detectors.detect_capture(quality)


@detector("det16_inline", "d_nosdp", "d_mux")
def _(v):
    return [detectors.detect_no_sdp(v.messages()), detectors.detect_rtcp_mux(streams.rtcp_on_media_count(v.packets()))]


# --- 2.10 reports ------------------------------------------------------------------------------------------


@query("rep1_narrative", "select call_id, \"index\", text, coalesce(frame_number, -1) as frame_number from nar", "nar")
def _(v):
    return _analysis(v)["narrative"].select("call_id", "index", "text", F.coalesce("frame_number", F.lit(-1)).alias("frame_number"))


_TITLES = {
    "SBC": "SBC (provable from this capture)", "GENESYS": "Genesys / recorder", "NETWORK": "Network / recording path", "CAPTURE": "Capture quality",
    "UNPROVABLE": "Not provable from SIPREC alone", "UNKNOWN": "Unclassified",
}
_TITLE_SQL = "case owner " + " ".join(f"when '{k}' then '{t}'" for k, t in _TITLES.items()) + " end"
_LINES_SQL = f"""
 select call_id, section, line, count(*) as n from (
   select call_id, 1 as section, unnest([concat('# SIPREC recording analysis — ', call_id), '', concat('- Overall health: **', overall_health, '**'),
          concat('- SRC / SBC: `', case when src_ip is null then 'unknown' else concat(src_ip, ':', src_port) end, '`'), concat('- SRS / recorder: `', case when srs_ip is null then 'unknown' else concat(srs_ip, ':', srs_port) end, '`'),
          concat('- Streams: ', declared, ' declared / ', observed, ' observed'), '- Generated: 2024-01-31T00:00:00Z', '']) as line from hl
   union all select call_id, 2, unnest(['## What happened', '', '']) from (select distinct call_id from nar)
   union all select call_id, 2, concat("index", '. ', text, case when coalesce(frame_number, 0) <> 0 then concat(' (frame ', frame_number, ')') else '' end) from nar
   union all select call_id, 3, unnest(['## Findings by owner', '']) from (select distinct call_id from fnd)
   union all select call_id, 3, unnest([concat('### ', {_TITLE_SQL}), '', '']) from (select distinct call_id, owner from fnd)
   union all select call_id, 3, concat('- `', severity, '` **', title, '**', case when clause is not null then concat(' [', clause, ']') else '' end, ': ', detail,
          case when len(frames) > 0 then concat(' — frames ', array_to_string(frames, ', ')) else '' end) from fnd
   union all select call_id, 4, unnest(['## Endpoint fingerprint', '', '| Actor | IP | User-Agent / Server | Via sent-by | SDP origin |', '| --- | --- | --- | --- | --- |', '']) from (select distinct call_id from fp)
   union all select call_id, 4, concat('| ', actor, ' | ', ip, ' | ', coalesce(user_agent, server, '—'), ' | ', coalesce(via_sent_by, '—'), ' | ', coalesce(sdp_origin_addr, '—'), ' |') from fp
   union all select call_id, 5, unnest(['## Observed media streams', '', '| SSRC | Dst | PT | Packets | Gaps | RTCP | Stream |', '| --- | --- | --- | --- | --- | --- | --- |', '']) from (select distinct call_id from bound)
   union all select call_id, 5, concat('| ', case when ssrc is null then '—' else concat('0x', printf('%08x', ssrc)) end, ' | ', dst_ip, ':', dst_port, ' | ', payload_type, ' | ', packet_count, ' | ', sequence_gaps, ' | ',
          case when rtcp_observed then 'yes' else 'no' end, ' | ', coalesce(matched_siprec_stream_id, matched_sdp_label, '—'), ' |') from bound)
 where line not like '  - Recommended:%' group by all"""


@query("rep2_escalation_markdown", _LINES_SQL.replace("unnest(['## Observed", "unnest(['## Observed"), "hl", "nar", "fnd", "fp", "bound")
def _(v):
    a = _analysis(v)
    lines = report.escalation_lines(
        a["call_health"], a["narrative"], a["findings"], a["fingerprints"], a["rtp_streams"], generated_at="2024-01-31T00:00:00Z",
        evidence=a["finding_evidence"],
    )
    return lines.where(~F.col("line").startswith("  - Recommended:")).groupBy("call_id", "section", "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rep3_coverage_timeline",
    """select call_id, label, 'segment' as kind, first_t as start_time, last_t as end_time, case when ssrc is null then '-' else concat('0x', printf('%08x', ssrc)) end as ssrc from seg
       union all select call_id, label, 'gap', start_time, end_time, concat('0x', printf('%08x', new_ssrc)) from cg""",
    "seg", "cg",
)
def _(v):
    s, lc = _lifecycles(v)
    out = report.coverage_segments(s, lifecycle.coverage_gaps(s, _holds(v), lc))
    return out.withColumn("ssrc", F.coalesce("ssrc", F.lit("-")))


@query(
    "rep3_mos_trend",
    """select call_id, coalesce(t_rel, -1.0::double) as t_rel, mos, case when mos < 2.6::double then 'poor' when mos < 3.6::double then 'degraded' else 'good' end as band, count(*) as n from smp group by all""", "smp",
)
def _(v):
    return report.mos_trend(_samples(v)).groupBy("call_id", F.coalesce("t_rel", F.lit(-1.0)).alias("t_rel"), "mos", "band").agg(F.count(F.lit(1)).alias("n"))
