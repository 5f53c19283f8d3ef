"""The whole analysis as one lazy plan over many calls."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

from ..functions.quality import ONE_WAY_DELAY_MS
from ..operators import binding, detectors, lifecycle, messages as msg, report, rtcp, scope, sip, ssrc, streams, timeline
from ..operators.findings import assign_owner, evidence_table, union_findings
from ..operators.health import call_facts, call_health
from ..operators.identity import correlation_keys, correlation_parts, fingerprints, ladder_rows
from ..operators.ordering import CHUNK_ROWS
from ..session import parquet_stage  # noqa: F401 - part of the public entry


@dataclass(frozen=True)
class Options:
    """Thresholds and choices of a run."""

    min_packets: int = streams.SUBSTANTIAL_MIN_PACKETS
    burst_min_count: int = sip.BURST_MIN_COUNT
    burst_window_s: float = sip.BURST_WINDOW_S
    one_way_delay_ms: float = ONE_WAY_DELAY_MS
    rtcp_scope: str = "ports"
    time_bound: bool = True
    unscoped_by_file: bool = True
    pre_scoped: bool = False
    include_stream_counts: bool = False
    packet_chunk_rows: int = CHUNK_ROWS
    message_chunk_rows: int = CHUNK_ROWS


@dataclass(frozen=True)
class Signalling:
    """Message tables every later step reads."""

    messages: DataFrame
    media: DataFrame
    snapshots: DataFrame
    rs_streams: DataFrame
    rs_participants: DataFrame
    rs_sessions: DataFrame


def signalling_tables(raw_messages: DataFrame) -> Signalling:
    """From message rows with text bodies to the signalling tables."""
    enriched = msg.enrich_messages(msg.index_messages(raw_messages))
    return Signalling(
        messages=enriched.drop("metadata"),
        media=msg.sdp_media(enriched),
        snapshots=msg.metadata_snapshots(enriched),
        rs_streams=msg.metadata_streams(enriched),
        rs_participants=msg.metadata_participants(enriched),
        rs_sessions=msg.metadata_sessions(enriched),
    )


def scoped_packets(sig: Signalling, packets: DataFrame, opts: Options) -> DataFrame:
    """Packets with their call; ``pre_scoped`` packets already carry call_id."""
    if opts.pre_scoped:
        return packets
    ports = scope.call_ports(sig.media)
    spans = msg.call_span(sig.messages) if opts.time_bound else None
    files = scope.calls_without_ports(sig.messages, ports) if opts.unscoped_by_file else None
    return scope.scope_media_to_calls(packets, ports, spans, files)


def rtcp_rows(sig: Signalling, packets: DataFrame, scoped: DataFrame, opts: Options) -> DataFrame:
    """RTCP of each call: on its ports, or of the capture files that carry it."""
    if opts.rtcp_scope == "capture":
        files = sig.messages.select("call_id", "file_idx").distinct()
        rows = packets.join(files, "file_idx").select("call_id", *packets.columns)
    else:
        rows = scoped
    return rows.where(scope.is_rtcp() | scope.is_mux_type())


def analyze(
    sig: Signalling,
    packets: DataFrame,
    opts: Options = Options(),
    quality: DataFrame | None = None,
    keep: Callable[[str, DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Every result table of the analysis by name.

    ``keep`` (see parquet_stage) materialises the tables that many detectors
    share; without it the result is one lazy plan.
    """
    keep = keep or (lambda name, df: df)
    sig = replace(sig, **{f.name: keep(f.name, getattr(sig, f.name)) for f in fields(sig)})
    m = sig.messages
    out: dict[str, DataFrame] = {
        "sip_messages": sip.flag_retransmissions(m).drop("first_idx"), "sdp_media": sig.media, "rs_metadata": sig.snapshots, "rs_streams": sig.rs_streams,
        "rs_participants": sig.rs_participants, "rs_sessions": sig.rs_sessions,
    }
    scoped = keep("scoped_packets", scoped_packets(sig, packets, opts))
    observed = streams.index_streams(streams.rtp_streams(scoped, opts.packet_chunk_rows))
    observed = streams.mark_rtcp_observed(observed, streams.rtcp_targets(scoped))
    changes = keep("ssrc_changes", ssrc.ssrc_changes(ssrc.ssrc_observations(scoped), opts.packet_chunk_rows))
    observed = keep("observed_streams", ssrc.annotate_ssrc_changes(observed, changes))
    matched = keep("matched_streams", binding.match_by_dst_port(observed, sig.media, sig.rs_streams))
    matched = binding.positional_fallback(matched, sig.rs_streams)
    bound = keep("rtp_streams", binding.bind_labels(matched, sig.media, sig.rs_streams, sig.rs_participants))
    out |= {"rtp_streams": bound, "ssrc_changes": changes}

    reports = keep("rtcp_rows", rtcp.chosen_rows(keep("rtcp_candidates", rtcp_rows(sig, packets, scoped, opts))))
    summary = rtcp.rtcp_summary(reports)
    stats = rtcp.rtcp_stats(reports)
    samples = rtcp.mos_samples(reports, bound, opts.one_way_delay_ms)
    estimates = rtcp.mos_estimates(samples, opts.one_way_delay_ms)
    out |= {"rtcp_summary": summary, "rtcp_stats": stats, "mos_samples": samples, "mos_estimates": estimates}

    scalars = timeline.timeline_scalars(m)
    windows = keep("hold_windows", timeline.hold_windows(m, opts.message_chunk_rows))
    holds = keep("hold_retrieve_events", timeline.hold_retrieve_events(m, opts.message_chunk_rows))
    members = keep(
        "burst_members",
        sip.burst_members(m, opts.burst_min_count, opts.burst_window_s, opts.message_chunk_rows),
    )
    bursts = sip.bursts(members)
    segments = keep("segments", lifecycle.lifecycle_segments(bound, m, opts.min_packets))
    lifecycles = keep("label_lifecycles", lifecycle.label_lifecycles(bound, segments, opts.min_packets))
    gaps = lifecycle.coverage_gaps(segments, holds, lifecycles)
    collisions = lifecycle.ssrc_collisions(segments, lifecycles)
    effects = lifecycle.burst_ssrc_effects(bursts, segments, lifecycles)
    out |= {
        "timelines": scalars, "hold_windows": windows, "timeline_events": timeline.timeline_events(m),
        "hold_retrieve_events": holds, "burst_members": members, "bursts": bursts, "segments": segments,
        "label_lifecycles": lifecycles, "coverage_gaps": gaps, "ssrc_collisions": collisions,
    }

    media_count = binding.distinct_media_count(bound)
    counts = detectors.media_counts(m, sig.snapshots, media_count)
    parts = [
        detectors.detect_no_sdp(m),
        detectors.detect_ssrc_changes(changes, bound, opts.min_packets),
        *detectors.detect_rtcp_quality(stats),
        detectors.detect_rtcp_presence(summary),
        detectors.detect_mos(estimates),
        detectors.detect_unbound_labels(sig.rs_streams, bound),
        *detectors.detect_gaps(bound, counts, scalars, windows),
        *detectors.detect_consistency(counts),
        detectors.detect_bursts(members),
        *detectors.detect_sip_timing(m),
        *detectors.detect_compliance(m, sig.snapshots),
        *detectors.detect_origins(m),
        detectors.detect_hold_retrieve(holds),
        *detectors.detect_lifecycle(gaps, collisions, lifecycles, segments),
        detectors.detect_burst_churn(bursts, effects, members),
        detectors.detect_rtcp_mux(streams.rtcp_on_media_count(scoped)),
    ]
    if opts.include_stream_counts:
        parts += detectors.detect_stream_counts(counts)
    if quality is not None:
        parts += detectors.detect_capture(quality)
    findings = keep("findings", assign_owner(union_findings(parts)))
    evidence = evidence_table(findings, detectors.grouped_evidence(m, members, holds))
    facts = keep("call_facts", call_facts(m, sig.snapshots, bound, summary, findings))
    health = call_health(facts)
    marks = fingerprints(m)
    steps = report.narrative(
        m, facts, scalars, media_count, bursts, holds, gaps, changes, findings
    )
    out |= {
        "findings": findings, "finding_evidence": evidence, "call_health": health, "fingerprints": marks, "narrative": steps,
        "correlation_keys": correlation_keys(m, correlation_parts(m, sig.rs_participants, bound)),
        "ladder": ladder_rows(m), "media_counts": counts, "summary": report.summary_records(health),
    }
    return out
