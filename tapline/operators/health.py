"""Component statuses and overall health per call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import severity_counts, severity_name, severity_rank
from .messages import call_endpoints, call_span


def call_facts(
    messages: DataFrame, snapshots: DataFrame, streams: DataFrame, rtcp_summary: DataFrame, findings: DataFrame
) -> DataFrame:
    """One wide row per call with every count the statuses and summaries need."""
    base = messages.groupBy("call_id").agg(
        F.bool_or("has_sdp").alias("has_sdp"), F.bool_or("has_metadata").alias("has_metadata")
    )
    declared = snapshots.groupBy("call_id").agg(F.sum("n_streams").cast("bigint").alias("declared"))
    seen = streams.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("observed"),
        F.sum("sequence_gaps").alias("gaps_total"),
        F.count_if(F.expr("not rtcp_observed")).alias("missing_rtcp"),
        F.min("first_t").alias("first_media_t"),
    )
    rtcp = rtcp_summary.select(
        "call_id", F.col("total").alias("rtcp_total"), "report_blocks", "sr", "rr",
    )
    out = (
        base.join(call_span(messages), "call_id")
        .join(call_endpoints(messages), "call_id")
        .join(declared, "call_id", "left")
        .join(seen, "call_id", "left")
        .join(rtcp, "call_id", "left")
        .join(severity_counts(findings), "call_id", "left")
    )
    numbers = [
        "declared", "observed", "gaps_total", "missing_rtcp", "rtcp_total", "report_blocks", "sr", "rr",
        "n_findings", "n_warnings", "n_errors",
    ]
    return out.fillna(0, subset=numbers)


def call_health(facts: DataFrame) -> DataFrame:
    """Seven statuses from the facts; the overall one is the worst of them and
    of the findings."""
    d, o = F.col("declared"), F.col("observed")
    status = {
        "status_sip": F.when(F.col("n_messages") > 0, "PASS").otherwise("CRITICAL"),
        "status_sdp": F.when(F.col("has_sdp"), "PASS").otherwise("ERROR"),
        "status_metadata": F.when(F.col("has_metadata"), "PASS").otherwise("WARN"),
        "status_rtp": F.when(o > 0, "PASS").otherwise("ERROR"),
        "status_rtcp": F.when((o > 0) & (F.col("report_blocks") > 0), "PASS").otherwise("WARN"),
        "status_streams": F.when((d == o) & (d > 0), "PASS")
        .when((o < d) & (o == 0), "ERROR")
        .otherwise("WARN"),
        "status_gaps": F.when(F.col("gaps_total") > 0, "WARN").otherwise("PASS"),
    }
    out = facts
    for name, value in status.items():
        out = out.withColumn(name, value)
    worst = F.greatest(*[severity_rank(name) for name in status], F.coalesce("worst_rank", F.lit(0)))
    return out.withColumn("overall_health", severity_name(worst)).drop("worst_rank")
