"""Roll-ups over many calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc


def _failed():
    return F.col("overall_health").isin("ERROR", "CRITICAL")


def batch_totals(health: DataFrame, bursts: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Calls, failures, codec flaps and one-way calls of a batch as one row.

    ``requested`` (call_id) also counts calls that were asked for and not found.
    """
    flaps = bursts.where("codec_renegotiation").select("call_id").distinct().withColumn("_f", F.lit(True))
    one_way = (F.col("declared") >= 2) & (F.col("observed") < F.col("declared"))
    total, failed = F.count(F.lit(1)), F.count_if(_failed())
    out = health.join(flaps, "call_id", "left").agg(
        total.alias("calls"),
        failed.alias("failed"),
        F.when(total > 0, sc.round_exact(failed / total, 4)).otherwise(F.lit(0.0)).alias("failure_rate"),
        F.count_if("_f").alias("codec_flap_calls"),
        F.count_if(one_way).alias("one_way_calls"),
    )
    if requested is None:
        return out
    missing = requested.select("call_id").distinct().join(health.select("call_id"), "call_id", "left_anti")
    return out.withColumn("calls_not_found", missing.agg(F.count(F.lit(1)).alias("n")).scalar())


def findings_by_code(findings: DataFrame) -> DataFrame:
    """Finding counts by code, most frequent first."""
    return findings.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code")


def findings_by_owner(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.coalesce("owner", F.lit("UNKNOWN")).alias("owner")).agg(F.count(F.lit(1)).alias("n"))


def daily_series(health: DataFrame) -> DataFrame:
    """Total and failed calls per UTC day of the first message."""
    return (
        health.where("start_epoch is not null")
        .groupBy(sc.utc_day("start_epoch").alias("day"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(_failed()).alias("failed"))
        .orderBy("day")
    )
