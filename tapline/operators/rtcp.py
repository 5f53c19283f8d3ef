"""RTCP: packet-type summary, report blocks, per-SSRC statistics, MOS."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import quality as q
from ..functions import scalars as sc
from .ordering import time_chunk
from .scope import is_mux_type, is_rtcp

# RTCP packet types.
PT_SR, PT_RR, PT_SDES, PT_BYE, PT_APP = 200, 201, 202, 203, 204
MUX_OFFSET = 128


def packet_types(rows: DataFrame) -> DataFrame:
    """Add ``pts``: RTCP types of a row; a media-port type stands for type + 128."""
    own = F.filter(sc.split_ints("rtcp_pt"), lambda v: v.isNotNull())
    mux = (F.size(own) == 0) & is_mux_type()
    return rows.withColumn("muxed", mux).withColumn(
        "pts",
        F.when(mux, F.array((F.col("p_type") + MUX_OFFSET).cast("bigint"))).otherwise(own),
    )


def block_array():
    """Report blocks of one row: identifiers, fractions, totals and jitters zipped."""
    zipped = F.arrays_zip(
        sc.split_ints("rtcp_ids").alias("ssrc"),
        sc.split_ints("rtcp_fraction").alias("fraction"),
        sc.split_ints("rtcp_cumulative").alias("cumulative"),
        sc.split_ints("rtcp_jitter").alias("jitter"),
    )
    return F.filter(
        zipped,
        lambda b: b["ssrc"].isNotNull() | b["fraction"].isNotNull() | b["jitter"].isNotNull(),
    )


def report_blocks(rows: DataFrame) -> DataFrame:
    """One row per report block, positioned by (file, frame, block)."""
    return rows.select(
        "call_id", "file_idx", "frame_number", "t_rel", F.posexplode(block_array()).alias("block", "b")
    ).select("call_id", "file_idx", "frame_number", "block", "t_rel", "b.*")


def rtcp_summary(rows: DataFrame) -> DataFrame:
    """Per call: RTCP rows, counts by type, report blocks, rows read as RTP."""
    typed = packet_types(rows).where(F.size("pts") > 0)

    def of(*values: int):
        return F.sum(F.size(F.filter("pts", lambda p: p.isin(*values))))

    scored = (F.coalesce("rtcp_fraction", F.lit("")) != "") | (F.coalesce("rtcp_jitter", F.lit("")) != "")
    known = (PT_SR, PT_RR, PT_SDES, PT_BYE, PT_APP)
    return typed.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("total"),
        of(PT_SR).alias("sr"),
        of(PT_RR).alias("rr"),
        of(PT_SDES).alias("sdes"),
        of(PT_BYE).alias("bye"),
        of(PT_APP).alias("app"),
        F.sum(F.size(F.filter("pts", lambda p: ~p.isin(*known)))).alias("other"),
        F.sum(F.when(scored, F.size(block_array())).otherwise(0)).alias("report_blocks"),
        F.count_if("muxed").alias("muxed_as_rtp"),
    )


def prefer_native_or_muxed(native: DataFrame, muxed: DataFrame) -> DataFrame:
    """Calls for which the media-port reading of RTCP replaces the native one.

    Taken only when the native rows have no report block and the other rows
    have some, or are more.
    """
    n = native.select("call_id", F.col("total").alias("nt"), F.col("report_blocks").alias("nb"))
    m = muxed.select("call_id", F.col("total").alias("mt"), F.col("report_blocks").alias("mb"))
    return n.join(m, "call_id", "full_outer").select(
        "call_id",
        (
            (F.coalesce("nb", F.lit(0)) == 0)
            & (
                (F.coalesce("mb", F.lit(0)) > 0)
                | (F.coalesce("mt", F.lit(0)) > F.coalesce("nt", F.lit(0)))
            )
        ).alias("use_muxed"),
    )


def chosen_rows(rows: DataFrame) -> DataFrame:
    """RTCP rows of each call, with media-port rows only where they replace the
    native reading (no native report block)."""
    native = rows.where(is_rtcp())
    taken = prefer_native_or_muxed(rtcp_summary(native), rtcp_summary(rows)).where("use_muxed").select("call_id")
    return native.unionByName(rows.where(~is_rtcp()).join(taken, "call_id", "left_semi"))


def bye_sources(rows: DataFrame) -> DataFrame:
    """Distinct (call, ssrc) that sent an RTCP BYE; a BYE without ids marks null."""
    typed = packet_types(rows.withColumn("p_type", F.lit(None).cast("int")))
    ids = sc.split_ints("rtcp_ids")
    return (
        typed.where(F.array_contains("pts", F.lit(PT_BYE).cast("bigint")))
        .select(
            "call_id",
            F.explode(F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit(None).cast("bigint")))).alias("ssrc"),
        )
        .distinct()
    )


def report_gaps(blocks: DataFrame, bucket_seconds: float = 600.0) -> DataFrame:
    """Longest pause between consecutive report times of an SSRC (two or more)."""
    rows = blocks.where("t_rel is not null").select(
        "call_id", F.coalesce("ssrc", F.lit(-1)).alias("_ssrc"), "t_rel",
        time_chunk("t_rel", bucket_seconds).alias("_bucket"),
    )
    part = ["call_id", "_ssrc", "_bucket"]
    inner = rows.withColumn("_p", F.lag("t_rel").over(W.partitionBy(*part).orderBy("t_rel")))
    buckets = inner.groupBy(*part).agg(
        F.min("t_rel").alias("t0"), F.max("t_rel").alias("t1"), F.max(F.col("t_rel") - F.col("_p")).alias("g")
    )
    border = F.col("t0") - F.lag("t1").over(W.partitionBy("call_id", "_ssrc").orderBy("_bucket"))
    return (
        buckets.withColumn("_g", F.greatest(F.col("g"), border))
        .groupBy("call_id", "_ssrc")
        .agg(F.max("_g").alias("max_gap"))
        .where("max_gap is not null")
    )


def rtcp_stats(rows: DataFrame, bucket_seconds: float = 600.0) -> DataFrame:
    """Loss, jitter and cadence per reported SSRC (null SSRC is a group)."""
    blocks = report_blocks(rows)
    keyed = blocks.withColumn("_ssrc", F.coalesce("ssrc", F.lit(-1)))
    at = F.struct("file_idx", "frame_number", "block")
    base = keyed.groupBy("call_id", "_ssrc").agg(
        F.count(F.lit(1)).alias("report_count"),
        (F.max("fraction") / F.lit(256.0)).alias("fraction_lost_max"),
        F.max_by("cumulative", F.when(F.col("cumulative").isNotNull(), at)).alias("cumulative_lost"),
        F.min("jitter").cast("double").alias("jitter_min"),
        F.avg("jitter").alias("jitter_avg"),
        F.max("jitter").cast("double").alias("jitter_max"),
    )
    byes = bye_sources(rows).select(
        "call_id", F.coalesce("ssrc", F.lit(-1)).alias("_ssrc"), F.lit(True).alias("_bye")
    )
    return (
        base.join(report_gaps(blocks, bucket_seconds), ["call_id", "_ssrc"], "left")
        .join(byes, ["call_id", "_ssrc"], "left")
        .select(
            "call_id",
            F.when(F.col("_ssrc") >= 0, F.col("_ssrc")).alias("ssrc"),
            "report_count", "fraction_lost_max", "cumulative_lost",
            "jitter_min", "jitter_avg", "jitter_max",
            F.lit(None).cast("double").alias("rtt_estimate_ms"),
            F.col("max_gap").alias("max_report_gap_s"),
            F.coalesce("_bye", F.lit(False)).alias("rtcp_bye_seen"),
        )
    )


def ssrc_lookup(streams: DataFrame) -> DataFrame:
    """Codec of the first stream with a payload type, names of the first stream."""
    rows = streams.withColumn("_ssrc", F.coalesce("ssrc", F.lit(-1)))
    typed = F.when(F.col("payload_type").isNotNull(), F.col("stream_idx"))
    return rows.groupBy("call_id", "_ssrc").agg(
        F.min_by("payload_type", typed).alias("payload_type"),
        F.min_by(
            F.struct(
                F.col("matched_sdp_label").alias("label"),
                F.coalesce(sc.blank_to_null("participant_name"), F.col("participant_aor")).alias("participant"),
            ),
            "stream_idx",
        ).alias("who"),
    )


def mos_samples(rows: DataFrame, streams: DataFrame, one_way_delay_ms: float = q.ONE_WAY_DELAY_MS) -> DataFrame:
    """Score every report block that carries a fraction or a jitter."""
    blocks = (
        report_blocks(rows)
        .where("fraction is not null or jitter is not null")
        .withColumn("_ssrc", F.coalesce("ssrc", F.lit(-1)))
    )
    joined = blocks.join(ssrc_lookup(streams), ["call_id", "_ssrc"], "left").withColumn(
        "_c", q.codec_for(F.col("payload_type"))
    )
    loss = F.coalesce("fraction", F.lit(0)) / F.lit(256.0) * F.lit(100.0)
    jitter = F.coalesce("jitter", F.lit(0)) * F.lit(1000.0) / F.col("_c.clock_hz")
    scored = joined.withColumn("_loss", loss).withColumn("_jit", jitter).withColumn(
        "_r",
        q.r_factor(
            F.col("_loss"), F.lit(float(one_way_delay_ms)) + F.lit(2.0) * F.col("_jit"),
            F.col("_c.ie"), F.col("_c.bpl"),
        ),
    )
    return scored.select(
        "call_id", "ssrc", "file_idx", "frame_number", "block", "t_rel",
        F.col("_c.codec").alias("codec"), F.col("who.label").alias("label"),
        F.col("who.participant").alias("participant"),
        q.r_to_mos(F.col("_r")).alias("mos"),
        sc.round_exact("_r", 1).alias("r_factor"),
        sc.round_exact("_loss", 2).alias("loss_pct"),
        sc.round_exact("_jit", 2).alias("jitter_ms"),
    )


def mos_estimates(samples: DataFrame, one_way_delay_ms: float = q.ONE_WAY_DELAY_MS) -> DataFrame:
    """Averages and the worst score per SSRC; the trend stays in the sample rows."""

    def mean(x: str, digits: int):
        # Hundredths are summed as integers, so the mean does not depend on row order.
        scaled = F.sum(F.round(F.col(x) * 100).cast("bigint"))
        return sc.round_exact(scaled / (F.count(x) * F.lit(100)), digits)

    return samples.groupBy("call_id", F.coalesce("ssrc", F.lit(-1)).alias("_ssrc")).agg(
        F.max("codec").alias("codec"),
        F.max("label").alias("label"),
        F.max("participant").alias("participant"),
        F.count(F.lit(1)).alias("n_samples"),
        mean("mos", 2).alias("mos_avg"),
        F.min("mos").alias("mos_min"),
        mean("r_factor", 1).alias("r_factor_avg"),
        mean("loss_pct", 2).alias("loss_pct_avg"),
        mean("jitter_ms", 2).alias("jitter_ms_avg"),
    ).select(
        "call_id",
        F.when(F.col("_ssrc") >= 0, F.col("_ssrc")).alias("ssrc"),
        "codec", "label", "participant", "n_samples", "mos_avg", "mos_min",
        "r_factor_avg", "loss_pct_avg", "jitter_ms_avg",
        F.lit(float(one_way_delay_ms)).alias("one_way_delay_ms"),
    )
