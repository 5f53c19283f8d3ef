"""RTP stream table: counts, first/last values, sequence gaps, RTCP presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as sc
from .ordering import CHUNK_ROWS, dense_index, with_previous
from .scope import is_mux_type, is_rtcp

# Fixed value: below this many packets a stream counts as noise.
SUBSTANTIAL_MIN_PACKETS = 100
# Packet order as one number: file index above a 40-bit frame number.
FRAME_BITS = 40


def with_order(packets: DataFrame) -> DataFrame:
    """Capture order (file, frame) as one growing BIGINT."""
    return packets.withColumn(
        "ord", F.shiftleft(F.col("file_idx").cast("bigint"), FRAME_BITS) + F.col("frame_number")
    )


def media_rows(scoped: DataFrame) -> DataFrame:
    """RTP only: no RTCP rows, no payload types that are RTCP on the media port."""
    return scoped.where(~is_rtcp() & ~is_mux_type())


def _keyed(scoped: DataFrame, chunk_rows: int) -> DataFrame:
    return (
        with_order(media_rows(scoped))
        .withColumn("_ssrc", F.coalesce("ssrc", F.lit(-1)))
        .withColumn("_dip", F.coalesce("dst_ip", F.lit("")))
        .withColumn("_dport", F.coalesce("dst_port", F.lit(-1)))
        .withColumn("_chunk", F.floor(F.col("ord") / F.lit(chunk_rows)).cast("bigint"))
    )


def sequence_steps(scoped: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Step from the previous sequence number of the stream, modulo 2^16."""
    rows = _keyed(scoped, chunk_rows).where("seq is not null")
    keys = ["call_id", "_ssrc", "_dip", "_dport"]
    out = with_previous(rows, keys, "_chunk", "ord", {"prev_seq": "seq"})
    step = (F.col("seq") - F.col("prev_seq")).bitwiseAND(65535)
    return out.where("prev_seq is not null").select(
        "call_id", "ssrc", "dst_ip", "dst_port", "file_idx", "frame_number", "seq", step.alias("delta")
    )


def rtp_streams(scoped: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per (call, ssrc, destination).

    Packets are reduced inside (stream, chunk) first; sequence steps across
    chunk borders are added from the chunk summaries. A stream that holds most
    of all packets is thus spread over as many tasks as it has chunks.
    """
    keys = ["call_id", "_ssrc", "_dip", "_dport"]
    part = [*keys, "_chunk"]
    upto = W.partitionBy(*part).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    rows = (
        _keyed(scoped, chunk_rows)
        .repartition(*part)
        .withColumn("_prev", F.last("seq", ignorenulls=True).over(upto))
    )
    jump = (F.col("seq") - F.col("_prev")).bitwiseAND(65535)
    timed = F.when(F.col("t_rel").isNotNull(), F.col("ord"))
    numbered = F.when(F.col("seq").isNotNull(), F.col("ord"))
    chunks = rows.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ord").alias("ord"),
        F.min_by(F.struct("src_ip", "src_port", "p_type"), "ord").alias("head"),
        F.min_by("t_rel", timed).alias("t0"),
        F.max_by("t_rel", timed).alias("t1"),
        F.min_by("seq", numbered).alias("s0"),
        F.max_by("seq", numbered).alias("s1"),
        F.count_if(jump > 1).alias("gaps"),
        F.max(F.when(jump > 1, jump - 1)).alias("worst"),
    )
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    linked = chunks.withColumn("_last", F.last("s1", ignorenulls=True).over(before))
    border = (F.col("s0") - F.col("_last")).bitwiseAND(65535)
    has_t = F.when(F.col("t0").isNotNull(), F.col("_chunk"))
    has_s = F.when(F.col("s0").isNotNull(), F.col("_chunk"))
    streams = linked.groupBy(*keys).agg(
        F.sum("n").alias("packet_count"),
        F.min("ord").alias("first_ord"),
        F.min_by("head", "_chunk").alias("head"),
        F.min_by("t0", has_t).alias("first_t"),
        F.max_by("t1", has_t).alias("last_t"),
        F.min_by("s0", has_s).alias("first_seq"),
        F.max_by("s1", has_s).alias("last_seq"),
        (F.sum("gaps") + F.count_if(border > 1)).alias("sequence_gaps"),
        F.coalesce(
            F.greatest(F.max("worst"), F.max(F.when(border > 1, border - 1))), F.lit(0)
        ).cast("bigint").alias("largest_gap"),
    )
    return streams.select(
        "call_id",
        "first_ord",
        F.when(F.col("_ssrc") >= 0, F.col("_ssrc")).alias("ssrc"),
        F.col("head.src_ip").alias("src_ip"),
        F.col("head.src_port").alias("src_port"),
        F.col("_dip").alias("dst_ip"),
        F.when(F.col("_dport") >= 0, F.col("_dport")).alias("dst_port"),
        F.col("head.p_type").alias("payload_type"),
        "packet_count", "first_t", "last_t", "first_seq", "last_seq", "sequence_gaps", "largest_gap",
    )


def index_streams(streams: DataFrame, chunk_frames: int = 1 << 24) -> DataFrame:
    """Number the streams of a call by their first packet."""
    keyed = streams.withColumn("_chunk", F.floor(F.col("first_ord") / F.lit(chunk_frames)).cast("bigint"))
    out = dense_index(
        keyed, ["call_id"], "_chunk", ["first_ord", "ssrc", "dst_ip", "dst_port"], "stream_idx"
    )
    return out.drop("_chunk")


def rtcp_targets(scoped: DataFrame) -> DataFrame:
    """Distinct destinations that received RTCP, on its own or the media port."""
    return (
        scoped.where(is_rtcp() | is_mux_type())
        .select("call_id", "dst_ip", "dst_port")
        .where("dst_port is not null")
        .distinct()
    )


def mark_rtcp_observed(streams: DataFrame, targets: DataFrame) -> DataFrame:
    """RTCP was seen on the stream's destination port or the one above it.

    Each target is widened to the two media ports it can serve, so the streams
    need one equi-join and no regrouping.
    """
    served = (
        targets.select(
            "call_id",
            "dst_ip",
            F.explode(F.array(F.col("dst_port"), F.col("dst_port") - 1)).alias("dst_port"),
        )
        .distinct()
        .withColumn("_seen", F.lit(True))
    )
    return streams.join(served, ["call_id", "dst_ip", "dst_port"], "left").select(
        *streams.columns, F.coalesce("_seen", F.lit(False)).alias("rtcp_observed")
    )


def rtcp_on_media_count(scoped: DataFrame) -> DataFrame:
    """RTCP packets inside the media filter of each call, on any of its ports."""
    return scoped.groupBy("call_id").agg(
        F.count_if(is_rtcp() | is_mux_type()).alias("rtcp_on_media_ports")
    )


def is_substantial(min_packets: int = SUBSTANTIAL_MIN_PACKETS):
    return F.coalesce(F.col("packet_count"), F.lit(0)) >= min_packets


def stream_report(streams: DataFrame, min_packets: int = SUBSTANTIAL_MIN_PACKETS) -> DataFrame:
    """Display rows of the stream table with the noise flag."""
    return streams.select(
        "call_id", "stream_idx",
        sc.ssrc_hex("ssrc", None).alias("ssrc"),
        "src_ip", "src_port", "dst_ip", "dst_port", "payload_type", "packet_count",
        F.col("first_t").alias("first_time"), F.col("last_t").alias("last_time"),
        "sequence_gaps", "largest_gap", "rtcp_observed",
        "matched_siprec_stream_id", "matched_sdp_label", "participant_aor", "participant_name",
        (~is_substantial(min_packets)).alias("is_noise"),
    )


def stream_noise_counts(streams: DataFrame, min_packets: int = SUBSTANTIAL_MIN_PACKETS) -> DataFrame:
    return streams.groupBy("call_id").agg(
        F.count_if(~is_substantial(min_packets)).alias("noise_stream_count"),
        F.count_if(is_substantial(min_packets)).alias("substantial_stream_count"),
    )
