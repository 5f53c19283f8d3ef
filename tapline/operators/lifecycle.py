"""Per-label SSRC lifecycles: segments, coverage gaps, collisions, burst effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from .binding import participant_labels
from .ordering import as_of_last, time_chunk, with_previous
from .sip import reinvites
from .streams import SUBSTANTIAL_MIN_PACKETS, is_substantial

# Fixed values.
TRIGGER_SLACK_S = 0.5
RETRIEVE_WINDOW_S = 3.0
BURST_MARGIN_S = 2.0
GAP_REASON = "SSRC changed on retrieve; a recorder tracking the prior SSRC would miss this audio."


def _labelled(bound: DataFrame) -> DataFrame:
    ports = F.concat(
        F.coalesce(F.col("src_port").cast("string"), F.lit("None")),
        F.lit("->"),
        F.coalesce(F.col("dst_port").cast("string"), F.lit("None")),
    )
    return bound.withColumn("port_key", ports).withColumn(
        "label", F.coalesce(sc.blank_to_null("matched_sdp_label"), ports)
    )


def lifecycle_segments(
    bound: DataFrame,
    messages: DataFrame,
    min_packets: int = SUBSTANTIAL_MIN_PACKETS,
    bucket_seconds: float = 600.0,
) -> DataFrame:
    """Substantial streams of a label in start order, each with the SSRC before it
    and the CSeq of the offer that triggered it."""
    rows = (
        _labelled(bound)
        .where(is_substantial(min_packets) & F.col("first_t").isNotNull())
        .select(
            "call_id", "label", "stream_idx", "ssrc", "first_t", "last_t", "packet_count", "port_key",
        )
    )
    offers = reinvites(messages).where(
        "upper(method) in ('INVITE', 'UPDATE') and t_rel is not null"
    ).select("call_id", F.col("t_rel").alias("offer_t"), "cseq")
    triggered = as_of_last(
        rows, offers, ["call_id"], "first_t", "offer_t", ["cseq"], {"trigger_cseq": "cseq"},
        tolerance=TRIGGER_SLACK_S, bucket_seconds=bucket_seconds,
    )
    ordered = triggered.withColumn("seg_ord", F.struct("first_t", "stream_idx")).withColumn(
        "_chunk", time_chunk("first_t", bucket_seconds)
    )
    out = with_previous(
        ordered, ["call_id", "label"], "_chunk", "seg_ord",
        {"prev_idx": "stream_idx", "prev_ssrc": "ssrc"},
    )
    return out.withColumn("is_first", F.col("prev_idx").isNull()).drop("_chunk", "prev_idx", "seg_ord")


def label_lifecycles(
    bound: DataFrame, segments: DataFrame, min_packets: int = SUBSTANTIAL_MIN_PACKETS
) -> DataFrame:
    """One row per label with at least one segment."""
    noise = _labelled(bound).groupBy("call_id", "label").agg(
        F.min("stream_idx").alias("lifecycle_ord"),
        F.count_if(
            ~(is_substantial(min_packets) & F.col("first_t").isNotNull())
        ).alias("noise_stream_count"),
    )
    span = (F.max(F.coalesce("last_t", F.lit(0.0))) - F.min("first_t")) / F.lit(60.0)
    life = segments.groupBy("call_id", "label").agg(
        F.min_by("port_key", F.struct("first_t", "stream_idx")).alias("port_key"),
        F.count(F.lit(1)).alias("n_segments"),
        F.greatest(span, F.lit(1e-6)).alias("_minutes"),
    )
    return (
        life.join(noise, ["call_id", "label"])
        .join(participant_labels(bound), ["call_id", "label"], "left")
        .select(
            "call_id", "label", "lifecycle_ord", "participant", "port_key", "n_segments",
            (F.col("n_segments") - 1).alias("ssrc_change_count"),
            sc.round_exact((F.col("n_segments") - 1) / F.col("_minutes"), 3).alias("stability_per_min"),
            "noise_stream_count",
        )
    )


def near_retrieve(segments: DataFrame, holds: DataFrame, within_s: float = RETRIEVE_WINDOW_S) -> DataFrame:
    """Segments that start within some seconds of a RETRIEVE.

    Times meet in buckets twice as wide as the window; only the retrieves are
    repeated over their neighbour buckets.
    """
    width = F.lit(2.0 * within_s)
    slot = F.floor(F.col("t_rel") / width).cast("bigint")
    retrieves = (
        holds.where("kind = 'RETRIEVE' and t_rel is not null")
        .select("call_id", F.col("t_rel").alias("r"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("_slot"))
    )
    keyed = segments.withColumn("_slot", F.floor(F.col("first_t") / width).cast("bigint"))
    cond = (
        (keyed["call_id"] == retrieves["call_id"])
        & (keyed["_slot"] == retrieves["_slot"])
        & (F.abs(keyed["first_t"] - retrieves["r"]) <= F.lit(within_s))
    )
    return keyed.join(retrieves, cond, "left_semi").drop("_slot")


def coverage_gaps(segments: DataFrame, holds: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """Later segments of a label that start at a retrieve."""
    hit = near_retrieve(segments.where("not is_first"), holds)
    names = lifecycles.select("call_id", "label", "lifecycle_ord", "participant")
    return hit.join(names, ["call_id", "label"]).select(
        "call_id", "label", "lifecycle_ord", "stream_idx", "participant",
        F.col("first_t").alias("start_time"), F.col("last_t").alias("end_time"),
        (F.col("last_t") - F.col("first_t")).alias("duration_s"),
        F.col("prev_ssrc").alias("old_ssrc"), F.col("ssrc").alias("new_ssrc"),
        F.lit(GAP_REASON).alias("reason"),
    )


def ssrc_collisions(segments: DataFrame, lifecycles: DataFrame, bucket_seconds: float = 60.0) -> DataFrame:
    """Pairs of different SSRCs of one label that overlap in time (ends included).

    The earlier segment is laid over the buckets it covers and the later one
    stands in the bucket of its start, so a pair is met once and pairs that are
    far apart are never built.
    """
    timed = segments.where("last_t is not null and packet_count > 1 and last_t >= first_t")

    def slot(c):
        return F.floor(F.col(c) / F.lit(bucket_seconds)).cast("bigint")

    a = timed.select(
        "call_id", "label", F.explode(F.sequence(slot("first_t"), slot("last_t"))).alias("_slot"),
        F.col("ssrc").alias("ssrc_a"), F.col("first_t").alias("a0"), F.col("last_t").alias("a1"),
        F.col("stream_idx").alias("idx_a"),
    )
    b = timed.select(
        "call_id", "label", slot("first_t").alias("_slot"),
        F.col("ssrc").alias("ssrc_b"), F.col("first_t").alias("b0"), F.col("last_t").alias("b1"),
        F.col("stream_idx").alias("idx_b"),
    )
    pairs = a.join(b, ["call_id", "label", "_slot"]).where(
        "(a0 < b0 or (a0 = b0 and idx_a < idx_b)) and b0 <= a1 and not (ssrc_a <=> ssrc_b)"
    )
    names = lifecycles.select("call_id", "label", "lifecycle_ord", "port_key")
    return pairs.join(names, ["call_id", "label"]).select(
        "call_id", "label", "lifecycle_ord", "port_key", "ssrc_a", "ssrc_b", "idx_a", "idx_b",
        F.col("b0").alias("overlap_start"), F.least("a1", "b1").alias("overlap_end"),
    )


def burst_changed_labels(bursts: DataFrame, segments: DataFrame, bucket_seconds: float = 30.0) -> DataFrame:
    """(call, burst, label) where a later segment starts around the burst."""

    def slot(c):
        return F.floor(c / F.lit(bucket_seconds)).cast("bigint")

    lo = F.col("window_start") - F.lit(BURST_MARGIN_S)
    hi = F.col("window_end") + F.lit(BURST_MARGIN_S)
    around = bursts.select(
        "call_id", "burst_idx", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(slot(lo), slot(hi))).alias("_slot")
    )
    starts = segments.where("not is_first").select(
        "call_id", "label", "first_t", slot(F.col("first_t")).alias("_slot")
    )
    return (
        around.join(starts, ["call_id", "_slot"])
        .where("first_t between lo and hi")
        .select("call_id", "burst_idx", "label")
        .distinct()
    )


def burst_ssrc_effects(bursts: DataFrame, segments: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """Bursts with at least one changed label, against every label of the call."""
    changed = burst_changed_labels(bursts, segments)
    hit = changed.select("call_id", "burst_idx").distinct()
    names = lifecycles.select(
        "call_id", "label", "lifecycle_ord",
        F.coalesce(sc.blank_to_null("participant"), F.concat(F.lit("label "), F.col("label"))).alias("name"),
    )
    return (
        hit.join(names, "call_id")
        .join(changed.withColumn("_c", F.lit(True)), ["call_id", "burst_idx", "label"], "left")
        .select("call_id", "burst_idx", "label", "lifecycle_ord", "name", F.coalesce("_c", F.lit(False)).alias("changed"))
    )
