"""SIP message rows: ordering, enrichment with SDP and metadata, endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import sdp as sdp_fn
from ..functions.rs_metadata import metadata_xml, parse_rs_metadata
from ..functions.text import body_parts, is_rs_metadata, strip
from ..session import parquet_stage
from .ordering import range_index


def index_messages(messages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Number the messages of a call by (relative time or 0, file, frame); messages with a Call-ID only."""
    keyed = messages.where("call_id is not null").withColumn("_t0", F.coalesce("t_rel", F.lit(0.0)))
    return range_index(keyed, ["call_id"], ["_t0", "file_idx", "frame_number"], "msg_idx", parquet_stage(messages.sparkSession), partitions).drop("_t0")


def filter_calls(rows: DataFrame, calls: DataFrame | str) -> DataFrame:
    """Rows of one Call-ID, or of every Call-ID in a one-column list."""
    if isinstance(calls, str):
        return rows.where(F.col("call_id") == F.lit(calls))
    return rows.join(calls.select("call_id").distinct(), "call_id", "left_semi")


def enrich_messages(messages: DataFrame) -> DataFrame:
    """Attach the SDP (last SDP part) and the recording metadata of each body."""
    parts = F.filter(
        body_parts("body", "content_type"),
        lambda p: F.coalesce(F.lower(p["content_type"]).contains("application/sdp"), F.lit(False))
        & (strip(p["content"]) != ""),
    )
    sdp_text = F.when(F.size(parts) > 0, F.element_at(parts, -1)["content"])
    return (
        messages.withColumn("_sdp_text", sdp_text)
        .withColumn("_xml", metadata_xml(F.col("body"), F.col("content_type"), F.col("raw_headers")))
        .withColumn("_sdp", sdp_fn.parse_sdp("_sdp_text"))
        .withColumn("metadata", parse_rs_metadata("_xml"))
        .withColumn("has_sdp", F.col("_sdp").isNotNull())
        .withColumn("sdp_origin", F.col("_sdp.origin"))
        .withColumn("media", F.col("_sdp.media"))
        .withColumn("has_metadata_body", F.col("metadata").isNotNull())
        .withColumn("has_metadata", F.col("has_metadata_body") | is_rs_metadata("content_type"))
        .drop("_sdp_text", "_xml", "_sdp")
    )


def sdp_media(messages: DataFrame) -> DataFrame:
    """One row per media line of every message."""
    return messages.select("call_id", "msg_idx", F.explode("media").alias("m")).select(
        "call_id", "msg_idx", "m.*"
    )


def metadata_snapshots(enriched: DataFrame) -> DataFrame:
    """One row per message that carried recording metadata."""
    return enriched.where("metadata is not null").select(
        "call_id",
        "msg_idx",
        F.col("metadata.version").alias("version"),
        F.col("metadata.raw_xml").alias("raw_xml"),
        F.size("metadata.sessions").alias("n_sessions"),
        F.size("metadata.participants").alias("n_participants"),
        F.size("metadata.streams").alias("n_streams"),
    )


def _unrolled(enriched: DataFrame, field: str) -> DataFrame:
    return (
        enriched.where("metadata is not null")
        .select("call_id", "msg_idx", F.posexplode(f"metadata.{field}").alias("ord", "x"))
        .select("call_id", "msg_idx", "ord", "x.*")
    )


def metadata_participants(enriched: DataFrame) -> DataFrame:
    return _unrolled(enriched, "participants")


def metadata_streams(enriched: DataFrame) -> DataFrame:
    return _unrolled(enriched, "streams")


def metadata_sessions(enriched: DataFrame) -> DataFrame:
    return _unrolled(enriched, "sessions")


def with_flags(messages: DataFrame) -> DataFrame:
    """Request/response flags and the CSeq method, shared by the detectors."""
    return (
        messages.withColumn("is_request", sc.is_request())
        .withColumn("is_response", sc.is_response())
        .withColumn("cmethod", sc.cseq_method())
    )


def first_invites(messages: DataFrame) -> DataFrame:
    """The first message with method INVITE of each call."""
    row = F.struct(
        "msg_idx", "frame_number", "t_rel", "src_ip", "src_port", "dst_ip", "dst_port",
        "direction", "body", "content_type", "media",
    )
    return (
        messages.where("method = 'INVITE'")
        .groupBy("call_id")
        .agg(F.min_by(row, "msg_idx").alias("i"))
        .select("call_id", "i.*")
    )


def call_endpoints(messages: DataFrame) -> DataFrame:
    """SRC and SRS of a call from its first INVITE; a blank ip is no endpoint."""
    row = F.struct("src_ip", "src_port", "dst_ip", "dst_port", "direction")
    first = (
        messages.groupBy("call_id")
        .agg(
            F.min_by(
                F.when(F.col("method") == "INVITE", row),
                F.when(F.col("method") == "INVITE", F.col("msg_idx")),
            ).alias("i")
        )
    )
    src = F.when(F.coalesce(F.col("i.src_ip"), F.lit("")) != "", F.struct(F.col("i.src_ip").alias("ip"), F.col("i.src_port").alias("port")))
    dst = F.when(F.coalesce(F.col("i.dst_ip"), F.lit("")) != "", F.struct(F.col("i.dst_ip").alias("ip"), F.col("i.dst_port").alias("port")))
    swapped = F.coalesce(F.col("i.direction") == "SRS_TO_SRC", F.lit(False))
    return (
        first.withColumn("a", F.when(swapped, dst).otherwise(src))
        .withColumn("b", F.when(swapped, src).otherwise(dst))
        .select(
            "call_id",
            F.col("a.ip").alias("src_ip"),
            F.col("a.port").alias("src_port"),
            F.col("b.ip").alias("srs_ip"),
            F.col("b.port").alias("srs_port"),
        )
    )


def call_span(messages: DataFrame) -> DataFrame:
    """First and last epoch second of a call and the duration between them."""
    return messages.groupBy("call_id").agg(
        F.min("ts_epoch").alias("start_epoch"),
        F.max("ts_epoch").alias("end_epoch"),
        F.count("ts_epoch").alias("n_epochs"),
        F.count(F.lit(1)).alias("n_messages"),
    )
