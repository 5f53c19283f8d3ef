"""Finding rules over the operator tables.

Codes, severities, owners, clauses and texts are the output contract, so the
strings here are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import scalars as sc
from ..functions import sdp as sdp_fn
from ..functions.text import body_parts
from . import sip as sip_ops
from .findings import evidence_counts, evidence_rows, finding, words
from .messages import call_endpoints, first_invites, with_flags
from .ordering import CHUNK_ROWS, as_of_last
from .ssrc import substantial_transitions
from .streams import SUBSTANTIAL_MIN_PACKETS

TIMING_SLACK_S = 2.0
HIGH_LOSS_FRACTION = 0.05
RTCP_GAP_S = 10.0
CHURN_WARN_PER_MIN = 1.0


# --- counts shared by several rules ---------------------------------------


def call_list(messages: DataFrame) -> DataFrame:
    return messages.select("call_id").distinct()


def declared_streams(snapshots: DataFrame, latest_only: bool = False) -> DataFrame:
    """Declared streams per call over all snapshots, or in the latest one."""
    if latest_only:
        agg = F.max_by("n_streams", "msg_idx")
    else:
        agg = F.sum("n_streams")
    return snapshots.groupBy("call_id").agg(
        agg.cast("bigint").alias("declared"), F.count(F.lit(1)).alias("n_snapshots")
    )


def sdp_media_count(messages: DataFrame) -> DataFrame:
    """Most audio/video lines carried by one message of the call."""
    real = F.size(F.filter("media", lambda m: m["media_type"].isin(*sdp_fn.MEDIA_TYPES)))
    return messages.groupBy("call_id").agg(
        F.max(F.when(F.col("media").isNotNull(), real).otherwise(0)).cast("bigint").alias("sdp_count")
    )


def media_counts(messages: DataFrame, snapshots: DataFrame, media_count: DataFrame) -> DataFrame:
    """declared, SDP and observed counts side by side, zero where nothing is."""
    return (
        sdp_media_count(messages)
        .join(declared_streams(snapshots), "call_id", "left")
        .join(media_count, "call_id", "left")
        .select(
            "call_id", "sdp_count",
            F.coalesce("declared", F.lit(0)).alias("declared"),
            F.coalesce("distinct_media", F.lit(0)).alias("distinct_media"),
            F.coalesce("observed", F.lit(0)).alias("observed"),
        )
    )


# --- media rules ------------------------------------------------------------


def detect_no_sdp(messages: DataFrame) -> DataFrame:
    rows = messages.groupBy("call_id").agg(F.bool_or("has_sdp").alias("_s")).where("not _s")
    return finding(
        rows, 10, "NO_SDP", "ERROR", "No SDP found",
        "No SDP found; RTP/RTCP stream extraction may be incomplete.",
    )


def detect_ssrc_changes(
    changes: DataFrame, streams: DataFrame, min_packets: int = SUBSTANTIAL_MIN_PACKETS
) -> DataFrame:
    rows = substantial_transitions(changes, streams, min_packets).where("real_changes > 0")
    noise = F.when(
        F.col("noise_changes") > 0,
        words(
            " (", F.col("noise_changes"),
            " additional transition(s) from low-packet-count streams excluded — likely STUN keepalives or RTCP-mux SR noise.)",
        ),
    ).otherwise("")
    return finding(
        rows, 20, "RTP_SSRC_CHANGE", "WARN", "SSRC changed mid-call",
        words(F.col("real_changes"), " SSRC change(s) observed mid-call across media flows.", noise),
        owner="SBC",
        recommendation="Frequent SSRC changes suggest the media feed to the recorder was restarted (transcoder swap, transfer, or re-anchoring).",
    )


def _ssrc_name() -> Column:
    return F.when(F.col("ssrc").isNotNull(), words("SSRC ", sc.ssrc_hex("ssrc"))).otherwise("stream")


def detect_rtcp_quality(stats: DataFrame) -> list[DataFrame]:
    name = _ssrc_name()
    sub = F.coalesce("ssrc", F.lit(-1))
    loss = finding(
        stats.where(F.col("fraction_lost_max") > F.lit(HIGH_LOSS_FRACTION)), 30, "RTCP_HIGH_LOSS", "WARN",
        "High RTCP-reported loss",
        words(name, " reported up to ", sc.one_decimal(F.col("fraction_lost_max") * F.lit(100.0)), "% packet loss on the recording path."),
        owner="NETWORK", recommendation="Investigate the SBC-to-recorder network path.", sub=sub,
    )
    gap = finding(
        stats.where(F.col("max_report_gap_s") > F.lit(RTCP_GAP_S)), 31, "RTCP_TIMEOUT", "WARN", "RTCP reporting gap",
        words(name, " had a ", sc.one_decimal("max_report_gap_s"), "s gap between RTCP reports (possible media stall or one-way path)."),
        owner="NETWORK", sub=sub,
    )
    bye = finding(
        stats.where("rtcp_bye_seen"), 32, "RTCP_BYE", "INFO", "RTCP BYE observed",
        words(name, " sent an RTCP BYE (stream ended)."), owner="UNKNOWN", sub=sub,
    )
    return [loss, gap, bye]


def detect_rtcp_presence(summary: DataFrame) -> DataFrame:
    tail = F.when(
        F.col("muxed_as_rtp") > 0,
        words(
            " ", F.col("muxed_as_rtp"),
            " of these were rtcp-mux'd onto the RTP port and dissected as RTP; re-run with rtcp-mux decoding to recover any report blocks.",
        ),
    ).otherwise(" The receiving side (recorder) is not sending Receiver Reports, or only one direction was captured.")
    return finding(
        summary.where("total > 0 and report_blocks = 0"), 33, "RTCP_NO_REPORTS", "WARN",
        "RTCP present but no quality reports",
        words(
            F.col("total"), " RTCP packet(s) seen (", F.col("sr"), " SR, ", F.col("rr"), " RR, ", F.col("sdes"),
            " SDES) but none carried a reception report block, so packet loss, jitter, and MOS cannot be computed from this capture.",
            tail,
        ),
        owner="UNKNOWN",
        recommendation="Capture both directions of the SBC-recorder leg; the recorder's Receiver Reports carry the loss/jitter that quality scoring needs.",
    )


def detect_mos(estimates: DataFrame) -> DataFrame:
    rows = estimates.where(F.col("mos_min") < q.MOS_WARN_BELOW)
    bad = F.col("mos_min") < q.MOS_ERROR_BELOW
    who = F.coalesce(
        sc.blank_to_null("participant"), F.concat(F.lit("label "), sc.blank_to_null("label")), _ssrc_name()
    )
    return finding(
        rows, 40, F.when(bad, "MOS_BAD").otherwise("MOS_LOW"), F.when(bad, "ERROR").otherwise("WARN"),
        words("Low call quality (MOS ", sc.one_decimal("mos_min"), ")"),
        words(
            who, " (", F.col("codec"), ") reached a ", F.when(bad, "poor").otherwise("degraded"), " MOS of ",
            sc.one_decimal("mos_min"), " (avg ", sc.one_decimal("mos_avg"), "); avg loss ",
            sc.one_decimal("loss_pct_avg"), "%, avg jitter ", sc.one_decimal("jitter_ms_avg", 0),
            "ms, assumed one-way delay ", sc.one_decimal("one_way_delay_ms", 0), "ms.",
        ),
        owner="NETWORK",
        recommendation="Correlate the low-MOS window with the timeline; if it aligns with a hold/retrieve or burst, the cause is signalling, not the path.",
        sub=F.coalesce("ssrc", F.lit(-1)),
    )


def detect_unbound_labels(rs_streams: DataFrame, bound: DataFrame) -> DataFrame:
    """Declared labels exist, and no stream of the call was bound to any label."""
    declared = rs_streams.where("coalesce(label, '') <> ''").groupBy("call_id").agg(
        F.array_sort(F.collect_set("label")).alias("labels")
    )
    any_bound = bound.where("coalesce(matched_sdp_label, '') <> ''").select("call_id").distinct()
    listed = F.concat(
        F.lit("['"), F.array_join("labels", "', '"), F.lit("']")
    )
    return finding(
        declared.join(any_bound, "call_id", "left_anti"), 50, "SIPREC-005", "WARN",
        "SIPREC labels not bound to any RTP stream",
        words("Metadata declared label(s) ", listed, " but none could be matched to an observed SSRC by port. SSRC-level diagnosis is limited."),
        owner="SBC",
    )


def streams_in_hold(streams: DataFrame, holds: DataFrame, bucket_seconds: float = 600.0) -> DataFrame:
    """Add ``in_hold``: the stream's whole interval lies in one hold window.

    Hold windows of a call follow each other, so only the last one opened at
    or before the stream's start can contain it.
    """
    hit = as_of_last(
        streams, holds.withColumn("_open", F.lit(True)), ["call_id"], "first_t", "hold_start", ["msg_idx"],
        {"_hold": "_open", "_hold_end": "hold_end"}, bucket_seconds=bucket_seconds,
    )
    inside = F.col("_hold") & (F.col("last_t") <= F.coalesce("_hold_end", F.lit(float("inf"))))
    return hit.withColumn("in_hold", F.coalesce(inside, F.lit(False))).drop("_hold", "_hold_end")


def detect_gaps(
    streams: DataFrame, counts: DataFrame, scalars: DataFrame, holds: DataFrame, bucket_seconds: float = 600.0
) -> list[DataFrame]:
    """Missing media, sequence gaps, missing RTCP, late start and early end."""
    none_seen = finding(
        counts.where("declared > 0 and observed = 0"), 60, "RTP_NONE_OBSERVED", "ERROR", "No RTP observed",
        words("Metadata declares ", F.col("declared"), " stream(s) but no RTP streams were observed in the capture."),
        recommendation="Verify media reaches the recorder and the capture point sees RTP, not just SIP.",
    )
    rows = streams_in_hold(streams, holds, bucket_seconds).withColumn(
        "_name", sc.stream_label("matched_siprec_stream_id", "ssrc", "dst_ip", "dst_port")
    )
    name = F.col("_name")

    def place(k: int):
        return F.col("stream_idx") * 4 + k

    seq = finding(
        rows.where("sequence_gaps > 0 and not in_hold"), 61, "RTP_SEQ_GAP", "WARN", "RTP sequence gaps",
        words(F.col("sequence_gaps"), " RTP sequence gap(s) on ", name, " (largest ", F.col("largest_gap"), ")."),
        recommendation="Investigate packet loss or capture drops.", sub=place(0),
    )
    rtcp = finding(
        rows.where("not rtcp_observed and not in_hold"), 61, "RTP_MISSING_RTCP", "WARN", "Missing RTCP",
        words("No RTCP observed for ", name, "."),
        recommendation="Confirm RTCP is enabled and not blocked.", sub=place(1),
    )
    timed = rows.join(scalars.where("established_at is not null"), "call_id")
    late_by = F.col("first_t") - F.col("established_at")
    late = finding(
        timed.where(late_by > TIMING_SLACK_S), 61, "RTP_LATE_START", "WARN", "Media started late",
        words(name, " RTP started ", sc.one_decimal(late_by, 2), "s after session establishment."), sub=place(2),
    )
    early_by = F.col("terminated_at") - F.col("last_t")
    early = finding(
        timed.where(early_by > TIMING_SLACK_S), 61, "RTP_EARLY_END", "WARN", "Media ended early",
        words(name, " RTP ended ", sc.one_decimal(early_by, 2), "s before session termination."), sub=place(3),
    )
    return [none_seen, seq, rtcp, late, early]


def detect_stream_counts(counts: DataFrame) -> list[DataFrame]:
    """Optional rules: declared against raw stream count, SDP lines against declared."""
    some = counts.where("declared > 0 or observed > 0")
    pair = words(F.col("declared"), " declared / ", F.col("observed"), " observed RTP stream(s)")
    return [
        finding(some.where("declared = observed"), 160, "MIX_STREAMS_OK", "INFO", "Stream count consistent", words(pair, ".")),
        finding(
            some.where("observed = 0 and declared > 0"), 160, "MIX_NONE_OBSERVED", "ERROR", "No observed streams",
            words(F.col("declared"), " stream(s) declared but none observed."),
            recommendation="Recording is likely failing; check media path.",
        ),
        finding(
            some.where("observed > 0 and observed < declared"), 160, "MIX_FEWER_OBSERVED", "WARN", "Fewer observed than declared",
            words(pair, "; at least one declared stream is missing."), recommendation="Check for one-sided recording.",
        ),
        finding(
            some.where("observed > declared"), 160, "MIX_MORE_OBSERVED", "WARN", "More observed than declared",
            words(pair, "; extra RTP streams have no matching declared metadata."),
        ),
        finding(
            counts.where("declared > 0 and sdp_count > 0 and sdp_count <> declared"), 161, "MIX_SDP_COUNT_MISMATCH", "WARN",
            "SDP m-line / metadata mismatch",
            words("SDP declares ", F.col("sdp_count"), " media section(s) but metadata declares ", F.col("declared"), " stream(s)."),
        ),
    ]


def detect_consistency(counts: DataFrame) -> list[DataFrame]:
    return [
        finding(
            counts.where("declared > 0 and distinct_media < declared"), 70, "CONSIST_METADATA_RTP", "ERROR",
            "Metadata declares more streams than were recorded",
            words(
                "The SBC's own metadata declared ", F.col("declared"), " stream(s) but only ", F.col("distinct_media"),
                " carried media to the recorder. The SBC's metadata and the media it sent disagree.",
            ),
            owner="SBC",
            recommendation="This is internally inconsistent on a single leg — not attributable to the far end. Escalate to the SBC team.",
        ),
        finding(
            counts.where("declared > 0 and sdp_count > 0 and sdp_count <> declared"), 71, "CONSIST_METADATA_SDP", "WARN",
            "Metadata / SDP stream-count mismatch",
            words("Metadata declares ", F.col("declared"), " stream(s); SDP offers ", F.col("sdp_count"), " media section(s)."),
            owner="SBC",
        ),
        finding(
            counts.where("sdp_count > 0 and distinct_media > sdp_count"), 72, "CONSIST_SDP_RTP", "WARN",
            "More RTP streams than SDP declared",
            words("SDP offered ", F.col("sdp_count"), " media section(s) but ", F.col("distinct_media"), " RTP stream(s) were observed."),
            owner="SBC",
        ),
    ]


# --- signalling rules ------------------------------------------------------


def detect_bursts(members: DataFrame) -> DataFrame:
    rows = sip_ops.bursts(members).join(evidence_counts(members, ["call_id", "burst_idx"]), ["call_id", "burst_idx"])
    extra = F.when(
        F.col("codec_renegotiation"),
        " Offered codec set changed across the burst — consistent with codec renegotiation.",
    ).otherwise("")
    return finding(
        rows, 80, "SIP_REINVITE_BURST", "WARN", "Re-INVITE burst",
        words(
            F.col("count"), " re-INVITE/UPDATE messages within ", sc.one_decimal(F.col("window_end") - F.col("window_start")),
            "s (starting at t=", sc.one_decimal("window_start"), "s).", extra,
        ),
        owner="SBC",
        recommendation="If codecs are flapping, review the SBC codec-policy; if the re-INVITEs are identical, check for glare (491) or session-timer churn.",
        frame_count=F.col("evidence_count"), sub=F.col("burst_idx"),
    )


def grouped_evidence(messages: DataFrame, members: DataFrame, holds: DataFrame) -> list[DataFrame]:
    """Evidence rows of all rules on groups: bursts, retransmissions, holds, burst churn."""
    return [
        evidence_rows(members, 80, F.col("burst_idx")),
        evidence_rows(sip_ops.flag_retransmissions(messages).where("first_idx is not null"), 90, F.col("first_idx")),
        evidence_rows(holds, 120),
        evidence_rows(members, 133, F.col("burst_idx")),
    ]


def detect_retransmissions(messages: DataFrame) -> DataFrame:
    groups = sip_ops.retransmission_groups(messages)
    members = sip_ops.flag_retransmissions(messages).where("first_idx is not null")
    rows = groups.join(evidence_counts(members, ["call_id", "first_idx"]), ["call_id", "first_idx"])
    none = F.lit("None")
    label = F.coalesce(F.when(F.col("kind") == "Q", F.col("what")).otherwise(words(F.col("what"), " response")), none)
    return finding(
        rows, 90, "SIP_RETRANSMISSION", "WARN", "SIP retransmission",
        words(
            label, " (CSeq ", F.coalesce("cseq", none), ") was transmitted ", F.col("n"),
            " times — suggests packet loss or an unresponsive peer.",
        ),
        owner="NETWORK", frame_count=F.col("evidence_count"), sub=F.col("first_idx"),
    )


def _fault_severity() -> Column:
    return F.when(F.col("status_code") >= 500, "ERROR").otherwise("WARN")


def detect_failures(messages: DataFrame) -> DataFrame:
    rows = messages.where("status_code >= 400")
    hint = sc.failure_hint("status_code")
    base = F.trim(words(F.col("status_code"), " ", F.coalesce("reason_phrase", F.lit(""))))
    return finding(
        rows, 91, "SIP_FAILURE_RESPONSE", _fault_severity(), words("SIP ", F.col("status_code"), " failure response"),
        F.when(hint.isNotNull(), words(base, " — ", hint)).otherwise(base),
        owner="UNKNOWN", frame=F.col("frame_number"), sub=F.col("msg_idx"),
    )


def detect_missing_ack(messages: DataFrame) -> DataFrame:
    return finding(
        sip_ops.calls_missing_ack(messages), 92, "SIP_MISSING_ACK", "ERROR", "Missing ACK",
        "A 200 OK to INVITE was seen but no ACK followed — the dialog never completed.", owner="UNKNOWN",
    )


def detect_slow_answer(messages: DataFrame) -> DataFrame:
    return finding(
        sip_ops.post_dial_delay(messages).where(F.col("pdd_s") > sip_ops.SLOW_ANSWER_S), 93, "SIP_SLOW_ANSWER", "WARN",
        "Slow answer (post-dial delay)", words("INVITE to 200 OK took ", sc.one_decimal("pdd_s"), "s."), owner="UNKNOWN",
    )


def detect_session_timer(messages: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return finding(
        sip_ops.session_timers(messages, chunk_rows).where("is_refresh"), 94, "SIP_SESSION_TIMER_REFRESH", "INFO",
        "Session-timer refresh pattern",
        words("Re-INVITE/UPDATE recurring roughly every ", sc.one_decimal("avg_s", 0), "s — looks like a session-timer refresh, not a fault."),
        owner="UNKNOWN",
    )


def detect_sip_timing(messages: DataFrame) -> list[DataFrame]:
    return [
        detect_retransmissions(messages),
        detect_failures(messages),
        detect_missing_ack(messages),
        detect_slow_answer(messages),
        detect_session_timer(messages),
    ]


def snapshots_unchanged(snapshots: DataFrame) -> DataFrame:
    """Calls that sent several metadata bodies, all the same after trimming."""
    body = sc.strip("raw_xml")
    return (
        snapshots.groupBy("call_id")
        .agg(F.count(F.lit(1)).alias("n_snapshots"), F.min(body).alias("_a"), F.max(body).alias("_b"))
        .where("n_snapshots > 1 and _a = _b")
        .select("call_id", "n_snapshots")
    )


def detect_compliance(messages: DataFrame, snapshots: DataFrame) -> list[DataFrame]:
    """Recording INVITE and metadata rules; a call without metadata gets only the first."""
    with_md = snapshots.select("call_id").distinct()
    none = finding(
        call_list(messages).join(with_md, "call_id", "left_anti"), 100, "SIPREC_NO_METADATA", "ERROR", "No SIPREC metadata",
        "The recording INVITE carried no application/rs-metadata body.", clause="RFC 7866 §6", owner="SBC",
    )
    invites = first_invites(messages).join(with_md, "call_id", "left_semi")
    parts = invites.select(
        "call_id", "frame_number", F.posexplode(body_parts("body", "content_type")).alias("pos", "part")
    ).withColumn("ct", F.col("part.content_type"))
    low = F.lower("ct")
    bad_type = finding(
        parts.where(low.contains("rs-metadata") & ~low.contains("+xml")), 101, "SIPREC_BAD_CONTENT_TYPE", "WARN",
        "Non-standard metadata Content-Type",
        words("Metadata part declared Content-Type '", F.col("ct"), "'; expected application/rs-metadata+xml."),
        clause="RFC 7865 §6", owner="SBC", frame=F.col("frame_number"), sub=F.col("pos"),
    )
    empty = "n_sessions = 0 and n_participants = 0 and n_streams = 0"
    invalid = finding(
        snapshots.where(empty), 102, "SIPREC_METADATA_INVALID", "ERROR", "SIPREC metadata invalid or empty",
        "Metadata XML was present but contained no session, participant, or stream elements.",
        clause="RFC 7865 §6", owner="SBC", sub=F.col("msg_idx"),
    )
    missing = F.concat_ws(
        ", ",
        F.when(F.col("n_sessions") == 0, "session"),
        F.when(F.col("n_participants") == 0, "participant"),
        F.when(F.col("n_streams") == 0, "stream"),
    )
    incomplete = finding(
        snapshots.where(~F.expr(empty) & (missing != "")), 102, "SIPREC_METADATA_INCOMPLETE", "WARN",
        "SIPREC metadata incomplete", words("Metadata is missing required element(s): ", missing, "."),
        clause="RFC 7865 §7", owner="SBC", sub=F.col("msg_idx"),
    )
    stale = finding(
        snapshots_unchanged(snapshots), 103, "SIPREC_NO_VERSION_INCREMENT", "WARN", "Metadata not updated across snapshots",
        "Multiple metadata bodies were sent but all were identical — updates should reflect state changes.",
        clause="RFC 7865 §6", owner="SBC",
    )
    lines = invites.select("call_id", "frame_number", F.posexplode("media").alias("pos", "m"))
    direction = F.col("m.direction")
    bad_dir = finding(
        lines.where((direction != "") & ~direction.isin("sendonly", "inactive")), 104, "SIPREC_BAD_DIRECTION", "WARN",
        "Unexpected media direction to recorder",
        words("Recording offer has a=", direction, " on a media line; the SRC should offer sendonly to the SRS."),
        clause="RFC 7866 §7.1.1", owner="SBC", frame=F.col("frame_number"), sub=F.col("pos"),
    )
    return [none, bad_type, invalid, incomplete, stale, bad_dir]


def message_origins(messages: DataFrame) -> DataFrame:
    """Failures and BYEs with the side that sent them."""
    ends = call_endpoints(messages).select("call_id", F.col("src_ip").alias("_src"), F.col("srs_ip").alias("_srs"))
    kind = F.when(F.col("is_response") & (F.col("status_code") >= 400), "failure").when(
        F.col("is_request") & (F.col("cmethod") == "BYE"), "bye"
    )
    ip = sc.blank_to_null("src_ip")
    return (
        with_flags(messages)
        .withColumn("kind", kind)
        .where("kind is not null")
        .join(ends, "call_id", "left")
        .withColumn("owner", F.when(ip == F.col("_src"), "SBC").when(ip == F.col("_srs"), "GENESYS").otherwise("UNKNOWN"))
        .withColumn(
            "who",
            F.when(F.col("owner") == "SBC", "SBC").when(F.col("owner") == "GENESYS", "Genesys/SRS")
            .otherwise(F.coalesce(ip, F.lit("unknown"))),
        )
        .drop("_src", "_srs")
    )


def detect_origins(messages: DataFrame) -> list[DataFrame]:
    rows = message_origins(messages)
    side = F.when(F.col("owner") == "GENESYS", "GENESYS").otherwise("SBC")
    failed = finding(
        rows.where("kind = 'failure'"), 110, words("ERR_ORIGIN_", side), _fault_severity(),
        words(F.col("status_code"), " emitted by ", F.col("who")),
        words(
            "A ", F.col("status_code"), " ", F.coalesce("reason_phrase", F.lit("")), " response was sent from ",
            F.col("src_ip"), " (", F.col("who"), ").",
        ),
        owner=F.col("owner"), frame=F.col("frame_number"), sub=F.col("msg_idx"),
    )
    bye = finding(
        rows.where("kind = 'bye'"), 110, words("BYE_ORIGIN_", side), "INFO", words("BYE sent by ", F.col("who")),
        words("The recording dialog was terminated by a BYE from ", F.col("src_ip"), " (", F.col("who"), ")."),
        owner=F.col("owner"), frame=F.col("frame_number"), sub=F.col("msg_idx"),
    )
    return [failed, bye]


def detect_hold_retrieve(holds: DataFrame) -> DataFrame:
    """One summary per call with hold events, in event order."""
    at = F.when(F.col("t_rel").isNotNull(), words("t=", sc.one_decimal("t_rel"), "s")).otherwise("t=?")
    text = words(F.col("kind"), " at ", at, " (CSeq ", F.coalesce("cseq", F.lit("None")), ")")
    rows = (
        holds.withColumn("_text", text)
        .groupBy("call_id")
        .agg(
            F.count_if(F.expr("kind = 'RETRIEVE'")).alias("cycles"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "_text"))), lambda s: s["_text"]), "; "
            ).alias("events"),
        )
        .join(evidence_counts(holds, ["call_id"]), "call_id")
    )
    return finding(
        rows, 120, "SIPREC-004", "INFO", "Hold/retrieve cycle detected",
        words(F.col("cycles"), " hold/retrieve cycle(s): ", F.col("events"), "."),
        clause="RFC 3264 §8.4", owner="SBC", frame_count=F.col("evidence_count"),
    )


# --- lifecycle rules --------------------------------------------------------


def detect_lifecycle(gaps: DataFrame, collisions: DataFrame, lifecycles: DataFrame, segments: DataFrame) -> list[DataFrame]:
    who = F.coalesce(sc.blank_to_null("participant"), words("label ", F.col("label")))
    lost = F.when(F.col("duration_s").isNotNull(), words(sc.one_decimal("duration_s", 0), "s")).otherwise("unknown duration")
    gap = finding(
        gaps, 130, "SIPREC-001", "CRITICAL", "Recording gap after retrieve (SSRC change)",
        words(
            "Stream ", who, " changed SSRC from ", sc.ssrc_hex("old_ssrc"), " to ", sc.ssrc_hex("new_ssrc"), " at t=",
            sc.one_decimal("start_time"), "s on retrieve. Estimated recording gap: ", lost,
            ". Verify the recorder followed the new SSRC.",
        ),
        owner="SBC", stream=F.col("label"),
        recommendation="Confirm rtpengine-recording re-learned the SSRC on retrieve; if not, this is the dropout.",
        sub=(F.col("lifecycle_ord"), F.col("stream_idx")),
    )
    clash = finding(
        collisions, 131, "SIPREC-003", "ERROR", "Two SSRCs active on one media port",
        words(
            "On label ", F.col("label"), " (", F.col("port_key"), "), SSRCs ", sc.ssrc_hex("ssrc_a"), " and ",
            sc.ssrc_hex("ssrc_b"), " overlapped between t=", sc.one_decimal("overlap_start"), "s and t=",
            sc.one_decimal("overlap_end"), "s — the recorder may capture the wrong one.",
        ),
        owner="SBC", stream=F.col("label"),
        sub=(F.col("lifecycle_ord"), F.col("idx_a"), F.col("idx_b")),
    )
    chain = segments.groupBy("call_id", "label").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("first_t", "stream_idx", sc.ssrc_hex("ssrc").alias("h")))),
                lambda s: s["h"],
            ),
            " -> ",
        ).alias("chain")
    )
    moved = lifecycles.where("ssrc_change_count > 0").join(chain, ["call_id", "label"])
    churn = finding(
        moved, 132, "SIPREC-002",
        F.when(F.col("stability_per_min") >= CHURN_WARN_PER_MIN, "WARN").otherwise("INFO"), "SSRC churn on a stream",
        words(who, " changed SSRC ", F.col("ssrc_change_count"), " time(s) (", F.col("stability_per_min"), "/min): ", F.col("chain")),
        owner="SBC", stream=F.col("label"), sub=F.col("lifecycle_ord"),
    )
    return [gap, clash, churn]


def detect_burst_churn(bursts: DataFrame, effects: DataFrame, members: DataFrame) -> DataFrame:
    def names(flag: str):
        return F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.expr(flag), F.struct("lifecycle_ord", "name")))), lambda s: s["name"]
            ),
            ", ",
        )

    rows = (
        effects.groupBy("call_id", "burst_idx")
        .agg(names("changed").alias("moved"), names("not changed").alias("still"))
        .join(bursts, ["call_id", "burst_idx"])
        .join(evidence_counts(members, ["call_id", "burst_idx"]), ["call_id", "burst_idx"])
    )
    tail = F.when(
        F.col("still") != "",
        words(" Asymmetric: ", F.col("still"), " did not change — the SBC handled the legs differently."),
    ).otherwise("")
    return finding(
        rows, 133, "SIPREC-002", "WARN", "Re-INVITE burst caused SSRC churn",
        words(
            "Re-INVITE burst at t=", sc.one_decimal("window_start", 0), "s coincided with SSRC change(s) on: ",
            F.col("moved"), ".", tail,
        ),
        owner="SBC", frame_count=F.col("evidence_count"), sub=F.col("burst_idx"),
    )


def detect_rtcp_mux(mux_counts: DataFrame) -> DataFrame:
    return finding(
        mux_counts.where("rtcp_on_media_ports > 0"), 140, "SIPREC-006", "INFO", "RTCP-mux packets on the RTP port",
        words(
            F.col("rtcp_on_media_ports"),
            " RTCP packet(s) were observed on the RTP media port (rtcp-mux); these are excluded from the stream table.",
        ),
        owner="UNKNOWN",
    )


def detect_capture(quality: DataFrame) -> list[DataFrame]:
    """Rules over one capture-quality row per call (or per run under one id)."""
    return [
        finding(
            quality.where("truncated"), 150, "CAP_TRUNCATED", "WARN", "Capture is snaplen-truncated",
            words("Packets were captured with a snaplen of ", F.coalesce(F.col("snaplen").cast("string"), F.lit("None")), "; payloads may be incomplete."),
            owner="CAPTURE", recommendation="Re-capture with full frame length (snaplen 0/65535).",
        ),
        finding(
            quality.where("drop_count > 0"), 151, "CAP_DROPS", "WARN", "Capture reported dropped packets",
            words(F.col("drop_count"), " packet(s) were dropped during capture — gaps may be capture artifacts, not network loss."),
            owner="CAPTURE",
        ),
    ]
