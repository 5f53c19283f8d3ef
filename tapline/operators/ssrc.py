"""SSRC changes on media flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from .ordering import CHUNK_ROWS, with_previous
from .scope import is_rtcp
from .streams import is_substantial, with_order, SUBSTANTIAL_MIN_PACKETS


def ssrc_observations(scoped: DataFrame) -> DataFrame:
    """(flow, time, ssrc) of every non-RTCP row with a readable SSRC."""
    return with_order(scoped.where(~is_rtcp() & F.col("ssrc").isNotNull())).select(
        "call_id",
        "ord",
        sc.flow_key("src_ip", "src_port", "dst_ip", "dst_port").alias("flow_key"),
        "t_rel",
        "ssrc",
    )


def ssrc_changes(observations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows whose SSRC differs from the one before it on the same flow."""
    rows = observations.withColumn("_chunk", F.floor(F.col("ord") / F.lit(chunk_rows)).cast("bigint"))
    out = with_previous(rows, ["call_id", "flow_key"], "_chunk", "ord", {"from_ssrc": "ssrc"})
    return out.where("from_ssrc <> ssrc").select(
        "call_id", "flow_key", "ord", "t_rel", "from_ssrc", F.col("ssrc").alias("to_ssrc")
    )


def annotate_ssrc_changes(streams: DataFrame, changes: DataFrame) -> DataFrame:
    """Put the number of changes of a flow on every stream of that flow."""
    per_flow = changes.groupBy("call_id", "flow_key").agg(F.count(F.lit(1)).alias("ssrc_changes"))
    keyed = streams.withColumn(
        "flow_key", sc.flow_key("src_ip", "src_port", "dst_ip", "dst_port")
    )
    return keyed.join(per_flow, ["call_id", "flow_key"], "left").select(
        *streams.columns, F.coalesce("ssrc_changes", F.lit(0)).alias("ssrc_changes")
    )


def substantial_transitions(
    changes: DataFrame, streams: DataFrame, min_packets: int = SUBSTANTIAL_MIN_PACKETS
) -> DataFrame:
    """Per call: changes that touch a substantial stream, and the rest as noise.

    A call without any stream keeps all its changes. Changes are counted per
    SSRC pair before they meet the stream table.
    """
    pairs = changes.groupBy("call_id", "from_ssrc", "to_ssrc").agg(F.count(F.lit(1)).alias("n"))
    solid = (
        streams.where(F.col("ssrc").isNotNull() & is_substantial(min_packets))
        .select("call_id", "ssrc")
        .distinct()
    )
    a = solid.select("call_id", F.col("ssrc").alias("from_ssrc"), F.lit(True).alias("_a"))
    b = solid.select("call_id", F.col("ssrc").alias("to_ssrc"), F.lit(True).alias("_b"))
    with_streams = streams.select("call_id").distinct().withColumn("_any", F.lit(True))
    marked = (
        pairs.join(a, ["call_id", "from_ssrc"], "left")
        .join(b, ["call_id", "to_ssrc"], "left")
        .join(with_streams, "call_id", "left")
    )
    real = F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False)) | F.col("_any").isNull()
    return marked.groupBy("call_id").agg(
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias("real_changes"),
        F.sum(F.when(~real, F.col("n")).otherwise(0)).alias("noise_changes"),
    )
