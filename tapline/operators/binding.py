"""Which declared stream, label and participant an observed RTP stream is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from .ordering import dense_index


def port_labels(media: DataFrame, use_mid: bool = False) -> DataFrame:
    """(call, port) -> label of the last media line that used the port.

    ``use_mid`` falls back to the media id where a line has no label.
    """
    label = sc.blank_to_null("label")
    if use_mid:
        label = F.coalesce(label, sc.blank_to_null("mid"))
    rows = media.withColumn("_l", label).where("port <> 0 and _l is not null")
    return rows.groupBy("call_id", "port").agg(
        F.max_by("_l", F.struct("msg_idx", "media_idx")).alias("label")
    )


def label_streams(rs_streams: DataFrame) -> DataFrame:
    """(call, label) -> declared stream id, later snapshots overwrite."""
    return (
        rs_streams.where("coalesce(label, '') <> ''")
        .groupBy("call_id", "label")
        .agg(F.max_by("stream_id", F.struct("msg_idx", "ord")).alias("stream_id"))
    )


def stream_participants(rs_streams: DataFrame, rs_participants: DataFrame) -> DataFrame:
    """(call, stream id) -> name and AOR of its first participant in id order."""
    ids = (
        rs_streams.where(F.size("participant_ids") > 0)
        .groupBy("call_id", "stream_id")
        .agg(F.max_by("participant_ids", F.struct("msg_idx", "ord")).alias("ids"))
        .select("call_id", "stream_id", F.element_at("ids", 1).alias("participant_id"))
    )
    people = rs_participants.groupBy("call_id", "participant_id").agg(
        F.max_by(F.struct("name", "aor"), F.struct("msg_idx", "ord")).alias("p")
    )
    return ids.join(people, ["call_id", "participant_id"]).select(
        "call_id", "stream_id", "participant_id",
        F.col("p.name").alias("participant_name"), F.col("p.aor").alias("participant_aor"),
    )


def label_participants(rs_streams: DataFrame, rs_participants: DataFrame) -> DataFrame:
    """(call, label) -> stream id and participant: the whole chain of lookups."""
    return (
        label_streams(rs_streams)
        .join(stream_participants(rs_streams, rs_participants), ["call_id", "stream_id"], "left")
        .select("call_id", "label", "stream_id", "participant_id", "participant_name", "participant_aor")
    )


def match_by_dst_port(streams: DataFrame, media: DataFrame, rs_streams: DataFrame) -> DataFrame:
    """Label (or media id) of the destination port, then the declared stream."""
    ports = port_labels(media, use_mid=True).select(
        "call_id", F.col("port").alias("dst_port"), F.col("label").alias("matched_sdp_label")
    )
    ids = label_streams(rs_streams).select(
        "call_id", F.col("label").alias("matched_sdp_label"), F.col("stream_id").alias("matched_siprec_stream_id")
    )
    return (
        streams.join(ports, ["call_id", "dst_port"], "left")
        .join(ids, ["call_id", "matched_sdp_label"], "left")
        .select(*streams.columns, "matched_sdp_label", "matched_siprec_stream_id")
    )


def unmatched_declared(matched: DataFrame, rs_streams: DataFrame) -> DataFrame:
    """Declared streams that no observed stream was matched to."""
    used = (
        matched.where("matched_siprec_stream_id is not null")
        .select("call_id", F.col("matched_siprec_stream_id").alias("stream_id"))
        .distinct()
    )
    return rs_streams.join(used, ["call_id", "stream_id"], "left_anti")


def positional_fallback(matched: DataFrame, rs_streams: DataFrame, chunk_rows: int = 1 << 18) -> DataFrame:
    """Pair leftovers by position in calls with equally many on both sides."""
    open_rtp = matched.where("matched_siprec_stream_id is null").select("call_id", "stream_idx")
    open_decl = unmatched_declared(matched, rs_streams).select("call_id", "msg_idx", "ord", "stream_id")
    counts = (
        open_rtp.groupBy("call_id")
        .agg(F.count(F.lit(1)).alias("_a"))
        .join(open_decl.groupBy("call_id").agg(F.count(F.lit(1)).alias("_b")).hint("merge"), "call_id")
        .where("_a = _b")
        .select("call_id")
        .hint("merge")
    )
    left = dense_index(
        open_rtp.join(counts, "call_id", "left_semi").withColumn(
            "_chunk", F.floor(F.col("stream_idx") / chunk_rows).cast("bigint")
        ),
        ["call_id"], "_chunk", ["stream_idx"], "_pos",
    ).drop("_chunk")
    right = dense_index(
        open_decl.join(counts, "call_id", "left_semi").withColumn(
            "_chunk", F.floor(F.col("msg_idx") / chunk_rows).cast("bigint")
        ),
        ["call_id"], "_chunk", ["msg_idx", "ord"], "_pos",
    ).select("call_id", "_pos", F.col("stream_id").alias("_sid"))
    pairs = left.join(right.hint("merge"), ["call_id", "_pos"]).select("call_id", "stream_idx", "_sid").hint("merge")
    return matched.join(pairs, ["call_id", "stream_idx"], "left").select(
        *[c for c in matched.columns if c != "matched_siprec_stream_id"],
        F.coalesce("matched_siprec_stream_id", "_sid").alias("matched_siprec_stream_id"),
    )


def bind_labels(
    matched: DataFrame, media: DataFrame, rs_streams: DataFrame, rs_participants: DataFrame
) -> DataFrame:
    """Label of the source port, else of the destination port, then its participant.

    Overrides an earlier match where a label is found.
    """
    ports = port_labels(media)
    by_src = ports.select("call_id", F.col("port").alias("src_port"), F.col("label").alias("_ls"))
    by_dst = ports.select("call_id", F.col("port").alias("dst_port"), F.col("label").alias("_ld"))
    chain = label_participants(rs_streams, rs_participants).select(
        "call_id", F.col("label").alias("_l"), F.col("stream_id").alias("_sid"),
        "participant_name", "participant_aor",
    )
    keep = [c for c in matched.columns if c not in ("matched_sdp_label", "matched_siprec_stream_id")]
    return (
        matched.join(by_src, ["call_id", "src_port"], "left")
        .join(by_dst, ["call_id", "dst_port"], "left")
        .withColumn("_l", F.coalesce("_ls", "_ld"))
        .join(chain.hint("merge"), ["call_id", "_l"], "left")
        .select(
            *keep,
            F.coalesce("_l", "matched_sdp_label").alias("matched_sdp_label"),
            F.coalesce(sc.blank_to_null("_sid"), "matched_siprec_stream_id").alias("matched_siprec_stream_id"),
            F.when(F.coalesce("_sid", F.lit("")) != "", F.col("participant_aor")).alias("participant_aor"),
            F.when(F.coalesce("_sid", F.lit("")) != "", F.col("participant_name")).alias("participant_name"),
        )
    )


def participant_labels(bound: DataFrame) -> DataFrame:
    """(call, label) -> display text of the first stream that names someone."""
    named = (F.coalesce("participant_name", F.lit("")) != "") | (F.coalesce("participant_aor", F.lit("")) != "")
    rows = bound.where((F.coalesce("matched_sdp_label", F.lit("")) != "") & named)
    return (
        rows.groupBy("call_id", F.col("matched_sdp_label").alias("label"))
        .agg(F.min_by(F.struct("participant_name", "participant_aor"), "stream_idx").alias("p"))
        .select("call_id", "label", sc.participant_text("p.participant_name", "p.participant_aor").alias("participant"))
    )


def distinct_media_count(bound: DataFrame) -> DataFrame:
    """Distinct labels of a call; without any, distinct destinations; else streams."""
    target = F.when(
        F.coalesce("dst_port", F.lit(0)) != 0,
        F.concat_ws(":", F.coalesce("dst_ip", F.lit("")), F.col("dst_port").cast("string")),
    )
    return (
        bound.groupBy("call_id")
        .agg(
            F.count_distinct(sc.blank_to_null("matched_sdp_label")).alias("_labels"),
            F.count_distinct(target).alias("_targets"),
            F.count(F.lit(1)).alias("observed"),
        )
        .select(
            "call_id",
            F.when(F.col("_labels") > 0, F.col("_labels"))
            .when(F.col("_targets") > 0, F.col("_targets"))
            .otherwise(F.col("observed"))
            .alias("distinct_media"),
            "observed",
        )
    )
