"""Report tables: narrative, status cards, summaries, escalation lines, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import scalars as sc
from .findings import by_owner, errors, evidence_table, evidence_text, place_in, words
from .messages import first_invites
from .ordering import dense_index
from .streams import stream_report

CLIPPED_START_S = 2.0
# Headings of the owner groups.
OWNER_TITLE = {
    "SBC": "SBC (provable from this capture)",
    "GENESYS": "Genesys / recorder",
    "NETWORK": "Network / recording path",
    "CAPTURE": "Capture quality",
    "UNPROVABLE": "Not provable from SIPREC alone",
    "UNKNOWN": "Unclassified",
}


def _place() -> Column:
    """Report place of a finding: numbers that compare one after the other."""
    return F.concat(place_in(F.col("ord")), F.col("sub"))


# --- narrative -------------------------------------------------------------


def narrative(
    messages: DataFrame,
    facts: DataFrame,
    scalars: DataFrame,
    media_count: DataFrame,
    bursts: DataFrame,
    holds: DataFrame,
    gaps: DataFrame,
    changes: DataFrame,
    findings: DataFrame,
) -> DataFrame:
    """Numbered sentences of every call, each sentence one row.

    ``facts`` is the per-call table of operators.health.
    """
    none_frame = F.lit(None).cast("bigint")
    call = facts.select("call_id", "src_ip", "srs_ip", "declared", "observed", "first_media_t").join(
        scalars.select("call_id", "established_at", "terminated_at"), "call_id", "left"
    )

    def who(ip: str) -> Column:
        c = sc.blank_to_null(ip)
        return (
            F.when(c == F.col("_src"), "the SBC")
            .when(c == F.col("_srs"), "the recorder")
            .otherwise(F.coalesce(c, F.lit("an endpoint")))
        )

    def step(rows: DataFrame, section: int, text, frame=None, sub=None) -> DataFrame:
        return rows.select(
            "call_id",
            F.lit(section).cast("bigint").alias("section"),
            (sub if sub is not None else place_in()).alias("sub"),
            (text if isinstance(text, Column) else F.lit(text)).alias("text"),
            (frame if frame is not None else none_frame).cast("bigint").alias("frame_number"),
        )

    ends = call.select("call_id", F.col("src_ip").alias("_src"), F.col("srs_ip").alias("_srs"), "declared")
    clause = F.when(
        F.col("declared") > 0, words(" carrying SIPREC metadata that declared ", F.col("declared"), " stream(s)")
    ).otherwise(" (no SIPREC metadata present)")
    invites = first_invites(messages).join(ends, "call_id")
    steps = step(
        invites, 1, words(who("src_ip"), " sent an INVITE to ", who("dst_ip"), clause, "."), F.col("frame_number")
    )

    answer = (
        messages.where("status_code between 200 and 299")
        .groupBy("call_id")
        .agg(F.min_by(F.struct("src_ip", "status_code", "reason_phrase", "frame_number"), "msg_idx").alias("a"))
        .select("call_id", "a.*")
        .join(ends, "call_id")
    )
    steps = steps.unionByName(
        step(
            answer, 2,
            words(who("src_ip"), " answered ", F.col("status_code"), " ", F.coalesce("reason_phrase", F.lit("")), "."),
            F.col("frame_number"),
        )
    )

    delay = F.col("first_media_t") - F.col("established_at")
    media_text = (
        F.when(
            (F.col("observed") > 0) & (delay > CLIPPED_START_S),
            words("RTP to the recorder did not start until ", sc.one_decimal(delay), "s after the session was established (clipped start)."),
        )
        .when((F.col("observed") > 0) & delay.isNotNull(), "RTP began flowing to the recorder shortly after answer.")
        .when(
            (F.col("observed") == 0) & (F.col("declared") > 0),
            "No RTP reached the recorder at all, despite metadata declaring media.",
        )
    )
    steps = steps.unionByName(step(call.withColumn("_t", media_text).where("_t is not null"), 3, F.col("_t")))

    extra = F.when(F.col("codec_renegotiation"), " and the offered codec set changed (codec renegotiation)").otherwise("")
    steps = steps.unionByName(
        step(
            bursts, 4,
            words("A burst of ", F.col("count"), " re-INVITE/UPDATE messages occurred around t=", sc.one_decimal("window_start", 0), "s", extra, "."),
            sub=place_in(F.col("burst_idx")),
        )
    )
    at = F.when(F.col("t_rel").isNotNull(), words("t=", sc.one_decimal("t_rel"), "s")).otherwise("an unknown time")
    steps = steps.unionByName(
        step(
            holds, 5,
            words(
                "The call was ", F.when(F.col("kind") == "HOLD", "placed on hold").otherwise("retrieved"), " at ", at,
                " (CSeq ", F.coalesce("cseq", F.lit("None")), ").",
            ),
            F.col("frame_number"), place_in(F.col("msg_idx")),
        )
    )
    lost = F.when(F.col("duration_s").isNotNull(), words(sc.one_decimal("duration_s", 0), "s")).otherwise("an unknown duration")
    steps = steps.unionByName(
        step(
            gaps, 6,
            words(
                "After retrieve, ", F.coalesce(sc.blank_to_null("participant"), words("label ", F.col("label"))),
                " changed SSRC from ", sc.ssrc_hex(F.coalesce("old_ssrc", F.lit(0))), " to ",
                sc.ssrc_hex(F.coalesce("new_ssrc", F.lit(0))),
                "; if the recorder did not follow the new SSRC, about ", lost, " of that stream's audio is missing.",
            ),
            sub=place_in((F.col("lifecycle_ord"), F.col("stream_idx"))),
        )
    )
    moved = (
        changes.groupBy("call_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(gaps.select("call_id").distinct(), "call_id", "left_anti")
    )
    steps = steps.unionByName(
        step(moved, 7, words("The media SSRC changed ", F.col("n"), " time(s) mid-call, indicating the feed was restarted."))
    )
    steps = steps.unionByName(
        step(errors(findings), 8, words("A problem was detected: ", F.col("title"), " — ", F.col("detail")), sub=_place())
    )
    byes = (
        messages.where(sc.is_request() & (F.upper("method") == "BYE"))
        .groupBy("call_id")
        .agg(F.min_by(F.struct("src_ip", "frame_number"), "msg_idx").alias("b"))
        .select("call_id", "b.*")
    )
    steps = steps.unionByName(
        step(
            byes.join(ends, "call_id"), 9,
            words("The recording dialog was ended by a BYE from ", who("src_ip"), "."), F.col("frame_number"),
        )
    )
    steps = steps.unionByName(
        step(
            call.where("terminated_at is null").join(byes, "call_id", "left_anti"), 9,
            "No BYE was seen — the recording dialog did not close cleanly in this capture.",
        )
    )
    totals = call.join(media_count.select("call_id", "distinct_media"), "call_id", "left").withColumn(
        "_o", F.coalesce("distinct_media", F.lit(0))
    )
    steps = steps.unionByName(
        step(
            totals, 10,
            F.when(
                F.col("declared") > 0,
                words("In total, ", F.col("_o"), " of ", F.col("declared"), " declared stream(s) carried media to the recorder."),
            ).otherwise(words("In total, ", F.col("_o"), " RTP stream(s) were observed.")),
        )
    )
    # Section, first place and the upper bits of the last of the first two: grows
    # with the order and cuts a call with very many sentences into pieces.
    first_two = F.slice("sub", 1, 2)
    upper = F.transform(first_two, lambda x, i: F.when(i + 1 == F.size(first_two), F.shiftright(x, 18)).otherwise(x))
    piece = F.concat(F.array("section"), upper)
    numbered = dense_index(
        steps.withColumn("_piece", piece), ["call_id"], "_piece", ["section", "sub", "text"], "_i"
    )
    return numbered.select("call_id", (F.col("_i") + 1).alias("index"), "text", "frame_number")


# --- cards and summaries -----------------------------------------------------


def status_cards(health: DataFrame) -> DataFrame:
    """Eight (name, status, detail) rows per call."""
    rtcp = (
        F.when(F.col("rtcp_total") == 0, "no RTCP observed")
        .when(F.col("report_blocks") > 0, words(F.col("report_blocks"), " reception reports"))
        .otherwise(
            words(F.col("rtcp_total"), " pkts (", F.col("sr"), " SR, ", F.col("rr"), " RR) — no reception reports, quality not scorable")
        )
    )

    def card(place: int, name: str, status, detail=None):
        return F.struct(
            F.lit(place).alias("place"), F.lit(name).alias("name"), status.alias("status"),
            (detail if detail is not None else F.lit(None).cast("string")).alias("detail"),
        )

    cards = F.array(
        card(0, "SIP", F.col("status_sip")),
        card(1, "SDP", F.col("status_sdp")),
        card(2, "Metadata", F.col("status_metadata")),
        card(3, "Streams", F.col("status_streams"), words(F.col("declared"), " declared / ", F.col("observed"), " observed")),
        card(4, "RTP", F.col("status_rtp")),
        card(5, "RTCP", F.col("status_rtcp"), rtcp),
        card(6, "Gaps", F.col("status_gaps")),
        card(
            7, "Findings", F.when(F.col("n_findings") > 0, "WARN").otherwise("PASS"),
            words(F.col("n_warnings"), " warnings, ", F.col("n_errors"), " errors"),
        ),
    )
    return health.select("call_id", F.explode(cards).alias("c")).select("call_id", "c.*")


def summary_records(health: DataFrame) -> DataFrame:
    """Machine-readable summary struct per call."""

    def end(prefix: str):
        return F.when(
            F.col(f"{prefix}_ip").isNotNull(),
            F.struct(F.col(f"{prefix}_ip").alias("ip"), F.col(f"{prefix}_port").alias("port")),
        ).alias(prefix)

    return health.select(
        "call_id",
        F.lit("SIPREC").alias("mode"),
        "overall_health",
        F.struct(
            *[F.col(f"status_{n}").alias(n) for n in ("sip", "sdp", "metadata", "rtp", "rtcp", "streams", "gaps")]
        ).alias("status"),
        F.col("declared").alias("streams_declared"),
        F.col("observed").alias("streams_observed"),
        F.col("n_warnings").alias("warnings"),
        F.col("n_errors").alias("errors"),
        F.col("n_messages").alias("sip_message_count"),
        end("src"),
        end("srs"),
    )


def duration_text(health: DataFrame) -> DataFrame:
    """Duration between the first and last message; unknown below two times."""
    return health.select(
        "call_id",
        F.when(F.col("n_epochs") >= 2, sc.format_duration(F.col("end_epoch") - F.col("start_epoch")))
        .otherwise("unknown")
        .alias("duration"),
    )


def summary_text(health: DataFrame, output: str = "(none)", report: str = "(none)") -> DataFrame:
    """Seventeen labelled lines per call as one text."""
    seconds = F.when(
        (F.coalesce("start_epoch", F.lit(0.0)) != 0) & (F.coalesce("end_epoch", F.lit(0.0)) != 0),
        F.col("end_epoch") - F.col("start_epoch"),
    )
    unknown = F.lit("unknown")
    rtcp_note = F.when(
        (F.col("status_rtcp") == "WARN") & (F.col("missing_rtcp") > 0),
        words(" missing for ", F.col("missing_rtcp"), " stream(s)"),
    ).otherwise("")
    gap_note = F.when(F.col("gaps_total") > 0, words(" ", F.col("gaps_total"), " RTP sequence gaps")).otherwise("")
    lines = [
        words("CALL-ID:      ", F.col("call_id")),
        F.lit("MODE:         SIPREC"),
        words("START:        ", F.coalesce(sc.epoch_to_utc("start_epoch", 3), unknown)),
        words("END:          ", F.coalesce(sc.epoch_to_utc("end_epoch", 3), unknown)),
        words("DURATION:     ", F.when(seconds.isNull(), unknown).otherwise(sc.format_duration(seconds))),
        words("SRC:          ", sc.endpoint_text("src_ip", "src_port")),
        words("SRS:          ", sc.endpoint_text("srs_ip", "srs_port")),
        words("SIP:          ", F.col("status_sip")),
        words("SDP:          ", F.col("status_sdp")),
        words("METADATA:     ", F.col("status_metadata")),
        words("STREAMS:      ", F.col("declared"), " declared / ", F.col("observed"), " observed"),
        words("RTP:          ", F.col("status_rtp")),
        words("RTCP:         ", F.col("status_rtcp"), rtcp_note),
        words("GAPS:         ", F.col("status_gaps"), gap_note),
        words("FINDINGS:     ", F.col("n_warnings"), " warnings, ", F.col("n_errors"), " errors"),
        words("OUTPUT-PCAP:  ", output),
        words("REPORT-HTML:  ", report),
    ]
    return health.select("call_id", F.concat_ws("\n", *lines).alias("summary"))


# --- escalation text -----------------------------------------------------------


def escalation_lines(
    health: DataFrame,
    steps: DataFrame,
    findings: DataFrame,
    fingerprints: DataFrame,
    streams: DataFrame,
    custody: DataFrame | None = None,
    generated_at: str = "",
    evidence: DataFrame | None = None,
) -> DataFrame:
    """The escalation report as ordered lines: (call_id, section, k1, k2, k3, line).

    ``evidence`` is the table of operators.findings.evidence_table; without it only
    the frames inside the findings are named.

    A report stays a set of rows, so a call of any size is written without
    collecting its text. ``custody`` is (call_id, file, sha256).
    """
    first, last = -(1 << 62), (1 << 62)

    def rows(df: DataFrame, section: int, k1, k2, lines: Column) -> DataFrame:
        return df.select(
            "call_id", F.lit(section).alias("section"),
            (k1 if isinstance(k1, Column) else F.lit(k1)).cast("bigint").alias("k1"),
            (k2 if isinstance(k2, Column) else place_in(F.lit(k2))).alias("k2"),
            F.posexplode(lines).alias("k3", "line"),
        )

    def lits(*xs: str) -> Column:
        return F.array(*[F.lit(x) for x in xs])

    def frame_section(items: DataFrame, section: int, *heading: str) -> DataFrame:
        calls = items.select("call_id").distinct()
        return rows(calls, section, first, 0, lits(*heading)).unionByName(rows(calls, section, last, 0, lits("")))

    dash = F.lit("—")

    def end(prefix: str) -> Column:
        ip, port = F.col(f"{prefix}_ip"), F.col(f"{prefix}_port")
        return F.coalesce(
            F.when(F.coalesce(port, F.lit(0)) != 0, words(ip, ":", port)).otherwise(ip), F.lit("unknown")
        )

    out = rows(
        health, 1, 0, 0,
        F.array(
            words("# SIPREC recording analysis — ", F.col("call_id")),
            F.lit(""),
            words("- Overall health: **", F.col("overall_health"), "**"),
            words("- SRC / SBC: `", end("src"), "`"),
            words("- SRS / recorder: `", end("srs"), "`"),
            words("- Streams: ", F.col("declared"), " declared / ", F.col("observed"), " observed"),
            F.lit(f"- Generated: {generated_at}"),
            F.lit(""),
        ),
    )
    seen = F.when(F.coalesce("frame_number", F.lit(0)) != 0, words(" (frame ", F.col("frame_number"), ")")).otherwise("")
    out = out.unionByName(frame_section(steps, 2, "## What happened", "")).unionByName(
        rows(steps, 2, F.col("index"), 0, F.array(words(F.col("index"), ". ", F.col("text"), seen)))
    )

    owned = by_owner(findings)
    groups = owned.select("call_id", "owner", "owner_place").distinct()
    title = F.lit(None).cast("string")
    for owner, text in OWNER_TITLE.items():
        title = F.when(F.col("owner") == owner, text).otherwise(title)
    clause = F.coalesce(words(" [", sc.blank_to_null("clause"), "]"), F.lit(""))
    if evidence is None:
        evidence = evidence_table(findings)
    owned = owned.join(evidence_text(evidence), ["call_id", "ord", "sub"], "left")
    frames = F.when(F.size("frames") > 0, words(" — frames ", F.array_join("frames", ", "))).otherwise("")
    item = words("- `", F.col("severity"), "` **", F.col("title"), "**", clause, ": ", F.col("detail"), frames)
    advice = words("  - Recommended: ", sc.blank_to_null("recommendation"))
    calls = owned.select("call_id").distinct()
    out = (
        out.unionByName(rows(calls, 3, first, 0, lits("## Findings by owner", "")))
        .unionByName(rows(groups, 3, F.col("owner_place"), first, F.array(words("### ", title), F.lit(""))))
        .unionByName(rows(owned, 3, F.col("owner_place"), _place(), F.filter(F.array(item, advice), lambda l: l.isNotNull())))
        .unionByName(rows(groups, 3, F.col("owner_place"), last, lits("")))
    )

    banner = F.coalesce(sc.blank_to_null("user_agent"), sc.blank_to_null("server"), dash)
    out = out.unionByName(
        frame_section(
            fingerprints, 4, "## Endpoint fingerprint", "",
            "| Actor | IP | User-Agent / Server | Via sent-by | SDP origin |", "| --- | --- | --- | --- | --- |",
        )
    ).unionByName(
        rows(
            fingerprints, 4, F.when(F.col("actor") == "SRC/SBC", 0).otherwise(1), 0,
            F.array(
                words(
                    "| ", F.col("actor"), " | ", F.coalesce("ip", dash), " | ", banner, " | ",
                    F.coalesce("via_sent_by", dash), " | ", F.coalesce("sdp_origin_addr", dash), " |",
                )
            ),
        )
    )

    shown = stream_report(streams)
    dst = F.when(F.coalesce("dst_port", F.lit(0)) != 0, words(F.col("dst_ip"), ":", F.col("dst_port"))).otherwise(F.col("dst_ip"))
    out = out.unionByName(
        frame_section(
            shown, 5, "## Observed media streams", "",
            "| SSRC | Dst | PT | Packets | Gaps | RTCP | Stream |", "| --- | --- | --- | --- | --- | --- | --- |",
        )
    ).unionByName(
        rows(
            shown, 5, F.col("stream_idx"), 0,
            F.array(
                words(
                    "| ", F.coalesce("ssrc", dash), " | ", dst, " | ",
                    F.coalesce(F.col("payload_type").cast("string"), dash), " | ", F.col("packet_count"), " | ",
                    F.col("sequence_gaps"), " | ", F.when(F.col("rtcp_observed"), "yes").otherwise("no"), " | ",
                    F.coalesce(sc.blank_to_null("matched_siprec_stream_id"), sc.blank_to_null("matched_sdp_label"), dash), " |",
                )
            ),
        )
    )

    open_ = owned.where("owner = 'UNPROVABLE'")
    out = out.unionByName(
        frame_section(
            open_, 6, "## Limits of this evidence", "",
            "The following cannot be isolated from a SIPREC-only capture and need the original call leg, the SBC's on-box capture, or Genesys-side logs to close:",
        )
    ).unionByName(rows(open_, 6, 0, _place(), F.array(words("- ", F.col("title"), ": ", F.col("detail")))))

    if custody is not None:
        out = out.unionByName(
            frame_section(
                custody, 7, "## Chain of custody", "",
                "Source capture SHA-256 (verify the analyzed files are unmodified):", "",
            )
        ).unionByName(
            rows(custody, 7, F.col("file_idx"), 0, F.array(words("- `", F.col("sha256"), "`  ", F.col("file"))))
        )
    return out


# --- display tables -----------------------------------------------------------


def coverage_segments(segments: DataFrame, gaps: DataFrame) -> DataFrame:
    """Bars of the coverage view: the segments of each label and its gaps."""
    return segments.select(
        "call_id", "label", F.lit("segment").alias("kind"),
        F.col("first_t").alias("start_time"), F.col("last_t").alias("end_time"), sc.ssrc_hex("ssrc", None).alias("ssrc"),
    ).unionByName(
        gaps.select("call_id", "label", F.lit("gap").alias("kind"), "start_time", "end_time", sc.ssrc_hex("new_ssrc", None).alias("ssrc"))
    )


def mos_trend(samples: DataFrame) -> DataFrame:
    """Points of the quality trend with their band, numbered in time order."""
    return samples.select(
        "call_id", sc.ssrc_hex("ssrc", None).alias("ssrc"), F.col("t_rel").isNull().alias("untimed"), "t_rel",
        "mos", "loss_pct", "jitter_ms", q.mos_band(F.col("mos")).alias("band"),
    )


def display_findings(findings: DataFrame) -> DataFrame:
    return findings.select(
        "call_id", "ord", "sub", "severity", "code", "title", "detail", "evidence_frames", "recommendation",
        F.coalesce("owner", F.lit("UNKNOWN")).alias("owner"), "clause", "evidence_streams",
    )


def display_rtcp(stats: DataFrame) -> DataFrame:
    return stats.withColumn("ssrc", sc.ssrc_hex("ssrc", None)).drop("rtt_estimate_ms")


def display_changes(changes: DataFrame) -> DataFrame:
    return changes.select(
        "call_id", "flow_key", F.col("t_rel").alias("time_relative"),
        sc.ssrc_hex("from_ssrc", None).alias("from_ssrc"), sc.ssrc_hex("to_ssrc", None).alias("to_ssrc"),
    )


def display_lifecycle_segments(segments: DataFrame) -> DataFrame:
    return segments.select(
        "call_id", "label", sc.ssrc_hex("ssrc", None).alias("ssrc"), F.col("first_t").alias("first_time"),
        F.col("last_t").alias("last_time"), "packet_count", "trigger_cseq",
    )


def display_mos(estimates: DataFrame) -> DataFrame:
    return estimates.withColumn("ssrc", sc.ssrc_hex("ssrc", None))


def display_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.select(
        "call_id", "label", "participant", "start_time", "end_time", "duration_s",
        sc.ssrc_hex("old_ssrc", None).alias("old_ssrc"), sc.ssrc_hex("new_ssrc", None).alias("new_ssrc"), "reason",
    )


def display_holds(holds: DataFrame) -> DataFrame:
    return holds.select("call_id", "kind", F.col("t_rel").alias("time_relative"), "frame_number", "cseq")


def report_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Display form of every table a report shows, from the analysis tables."""
    return {
        "status_cards": status_cards(tables["call_health"]),
        "duration": duration_text(tables["call_health"]),
        "ladder": tables["ladder"],
        "narrative": tables["narrative"],
        "streams": stream_report(tables["rtp_streams"]),
        "findings": display_findings(tables["findings"]),
        "findings_by_owner": by_owner(tables["findings"]),
        "fingerprints": tables["fingerprints"],
        "rtcp_stats": display_rtcp(tables["rtcp_stats"]),
        "mos_estimates": display_mos(tables["mos_estimates"]),
        "mos_trend": mos_trend(tables["mos_samples"]),
        "ssrc_changes": display_changes(tables["ssrc_changes"]),
        "bursts": tables["bursts"],
        "lifecycles": tables["label_lifecycles"],
        "lifecycle_segments": display_lifecycle_segments(tables["segments"]),
        "coverage": coverage_segments(tables["segments"], tables["coverage_gaps"]),
        "coverage_gaps": display_gaps(tables["coverage_gaps"]),
        "hold_retrieve_events": display_holds(tables["hold_retrieve_events"]),
    }
