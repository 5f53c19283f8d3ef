"""Writers of result tables and per-call files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import case_dir_name

PROFILE_SCHEMA = (
    "declared_streams bigint, observed_streams bigint, codec_sets array<array<string>>, "
    "metadata_present boolean, fingerprint_banners array<string>, media_directions array<string>"
)
# Result table -> file name of the per-call JSON.
CASE_FILES = {
    "summary": "summary",
    "rs_metadata": "siprec-metadata",
    "rs_streams": "siprec-metadata-streams",
    "rs_participants": "siprec-metadata-participants",
    "rs_sessions": "siprec-metadata-sessions",
    "rtp_streams": "media-streams",
    "findings": "findings",
    "rtcp_stats": "rtcp-stats",
    "correlation_keys": "correlation-key",
}


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_case_tables(tables: dict[str, DataFrame], path: str, fmt: str = "json") -> None:
    """One folder per table, one sub-folder per call inside it.

    Rows are range-partitioned on the call and a row hash: small calls have one file,
    a large one is spread, and there are at most tasks + calls files in all. The parts are
    given by number: the work is opening a file for each call, which bytes do not tell.
    """
    for name, df in tables.items():
        target = CASE_FILES.get(name, name)
        plain = [c for c, kind in df.dtypes if "map<" not in kind]
        keyed = df.withColumn("case", case_dir_name("call_id")).withColumn("_spread", F.xxhash64(*plain))
        keyed.repartitionByRange(_parts(df), "case", "_spread").sortWithinPartitions("case").drop("_spread").write.mode("overwrite").partitionBy(
            "case"
        ).format(fmt).save(f"{path}/{target}")


def write_text_by_call(lines: DataFrame, path: str, order: list[str], column: str = "line") -> None:
    """Ordered text lines of each call below its own folder.

    Rows are range-partitioned on the order, so a long text spans several part
    files whose names keep the order.
    """
    keyed = lines.withColumn("case", case_dir_name("call_id"))
    keyed.repartitionByRange(_parts(lines), "case", *order).sortWithinPartitions("case", *order).select("case", column).write.mode(
        "overwrite"
    ).partitionBy("case").text(path)


def write_focused_packets(packets: DataFrame, path: str) -> None:
    """All packets of each call as parquet, in time order within files."""
    keyed = packets.withColumn("case", case_dir_name("call_id"))
    keyed.repartitionByRange(_parts(packets), "case", "ts_epoch").sortWithinPartitions("case", "ts_epoch").write.mode(
        "overwrite"
    ).partitionBy("case").parquet(path)


def write_batch_aggregate(totals: DataFrame, by_code: DataFrame, by_owner: DataFrame, series: DataFrame, path: str) -> None:
    """Aggregate record of a batch as JSON tables."""
    for name, df in (("totals", totals), ("findings_by_code", by_code), ("findings_by_owner", by_owner), ("time_series", series)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def save_profile(profile: DataFrame, path: str) -> None:
    profile.drop("call_id").write.mode("overwrite").json(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).json(path)


def findings_with_frames(findings: DataFrame) -> DataFrame:
    """Findings one row per evidence frame, for joining back to packets."""
    return findings.select("call_id", "ord", "sub", "code", F.posexplode("evidence_frames").alias("pos", "frame_number"))
