"""The findings table: schema, owners, evidence, union, views by owner."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities from best to worst.
SEVERITY_RANK = {"PASS": 0, "INFO": 1, "WARN": 2, "ERROR": 3, "CRITICAL": 4}

# Owner of a finding code whose detector names none.
OWNER_BY_CODE = {
    "NO_SDP": "SBC",
    "RTP_NONE_OBSERVED": "SBC",
    "RTP_SEQ_GAP": "NETWORK",
    "RTP_MISSING_RTCP": "NETWORK",
    "RTP_LATE_START": "SBC",
    "RTP_EARLY_END": "SBC",
    "MIX_STREAMS_OK": "UNKNOWN",
    "MIX_NONE_OBSERVED": "SBC",
    "MIX_FEWER_OBSERVED": "SBC",
    "MIX_MORE_OBSERVED": "SBC",
    "MIX_SDP_COUNT_MISMATCH": "SBC",
    "SIPREC-001": "SBC",
    "SIPREC-002": "SBC",
    "SIPREC-003": "SBC",
    "SIPREC-004": "SBC",
    "SIPREC-005": "SBC",
    "SIPREC-006": "UNKNOWN",
    "MOS_LOW": "NETWORK",
    "MOS_BAD": "NETWORK",
    "RTCP_NO_REPORTS": "UNKNOWN",
}
# Display order of owners.
OWNER_ORDER = ("SBC", "GENESYS", "NETWORK", "CAPTURE", "UNPROVABLE", "UNKNOWN")

COLUMNS = (
    "call_id", "ord", "sub", "severity", "code", "title", "detail", "evidence_frames",
    "evidence_count", "recommendation", "owner", "clause", "evidence_streams",
)


def words(*parts) -> Column:
    """Concatenate literals and columns as text."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _as_column(value, sql_type: str = "string") -> Column:
    if isinstance(value, Column):
        return value.cast(sql_type)
    return F.lit(value).cast(sql_type)


def place_in(sub: Column | tuple[Column, ...] = ()) -> Column:
    parts = sub if isinstance(sub, tuple) else (sub,)
    return F.array(*[p.cast("bigint") for p in parts or (F.lit(0),)])


def finding(
    rows: DataFrame,
    order: int,
    code,
    severity,
    title,
    detail,
    owner=None,
    clause=None,
    recommendation=None,
    frame: Column | None = None,
    frame_count: Column | None = None,
    stream: Column | None = None,
    sub: Column | tuple[Column, ...] = (),
) -> DataFrame:
    """Rows of a detector in the findings schema.

    ``order`` is the detector's place in a report and ``sub`` the row's place
    within it: an array of numbers that compare one after the other. A rule on
    one message names its ``frame``; a rule on a group gives the number of its
    frames, which stand in the evidence table (``evidence_rows``).
    """
    evidence = F.array(frame) if frame is not None else F.array()
    count = frame_count if frame_count is not None else F.size(evidence)
    return rows.select(
        "call_id",
        F.lit(order).alias("ord"),
        place_in(sub).alias("sub"),
        _as_column(severity).alias("severity"),
        _as_column(code).alias("code"),
        _as_column(title).alias("title"),
        _as_column(detail).alias("detail"),
        evidence.cast("array<bigint>").alias("evidence_frames"),
        F.lit(count).cast("bigint").alias("evidence_count") if not isinstance(count, Column) else count.cast("bigint").alias("evidence_count"),
        _as_column(recommendation).alias("recommendation"),
        _as_column(owner).alias("owner"),
        _as_column(clause).alias("clause"),
        (F.array(stream) if stream is not None else F.array()).cast("array<string>").alias("evidence_streams"),
    )


def evidence_counts(members: DataFrame, keys: list[str]) -> DataFrame:
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("evidence_count"))


def evidence_rows(members: DataFrame, order: int, sub: Column | tuple[Column, ...] = ()) -> DataFrame:
    """Frames of a grouped rule's findings: one row per frame, ``pos`` the message's place."""
    return members.select(
        "call_id", F.lit(order).alias("ord"), place_in(sub).alias("sub"), F.col("msg_idx").cast("bigint").alias("pos"),
        F.col("frame_number").cast("bigint").alias("frame_number"),
    )


def evidence_table(findings: DataFrame, grouped: Iterable[DataFrame] = ()) -> DataFrame:
    """(call_id, ord, sub, pos, frame_number) of every finding, one row per frame at any size.

    ``grouped`` are evidence rows of rules on groups; those without a finding are left out.
    """
    key = ["call_id", "ord", "sub"]
    out = findings.select(*key, F.posexplode("evidence_frames").alias("pos", "frame_number"))
    out = out.withColumn("pos", F.col("pos").cast("bigint"))
    for rows in grouped:
        out = out.unionByName(rows.join(findings.select(*key), key, "left_semi"))
    return out


def evidence_text(evidence: DataFrame) -> DataFrame:
    """(call_id, ord, sub, frames): the frames of a finding as the one text that a report line is."""
    return evidence.groupBy("call_id", "ord", "sub").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "frame_number"))), lambda s: s["frame_number"].cast("string")).alias("frames")
    )


def union_findings(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def assign_owner(findings: DataFrame) -> DataFrame:
    """Fill the owner where the detector left it open."""
    known = F.lit(None).cast("string")
    for code, owner in OWNER_BY_CODE.items():
        known = F.when(F.col("code") == code, F.lit(owner)).otherwise(known)
    return findings.withColumn("owner", F.coalesce("owner", known, F.lit("UNKNOWN")))


def severity_rank(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANK.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, number in SEVERITY_RANK.items():
        out = F.when(rank == number, F.lit(name)).otherwise(out)
    return out


def warnings(findings: DataFrame) -> DataFrame:
    return findings.where("severity = 'WARN'")


def errors(findings: DataFrame) -> DataFrame:
    return findings.where("severity in ('ERROR', 'CRITICAL')")


def severity_counts(findings: DataFrame) -> DataFrame:
    """Per call: findings, warnings, errors and the worst severity rank."""
    return findings.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.count_if(F.expr("severity = 'WARN'")).alias("n_warnings"),
        F.count_if(F.expr("severity in ('ERROR', 'CRITICAL')")).alias("n_errors"),
        F.max(severity_rank("severity")).alias("worst_rank"),
    )


def by_owner(findings: DataFrame) -> DataFrame:
    """Findings grouped for display: owner place, then report order."""
    owner = F.coalesce("owner", F.lit("UNKNOWN"))
    place = F.array_position(F.array(*[F.lit(o) for o in OWNER_ORDER]), owner)
    return findings.withColumn("owner", owner).withColumn("owner_place", place)


def owner_counts(findings: DataFrame) -> DataFrame:
    return by_owner(findings).groupBy("call_id", "owner").agg(F.count(F.lit(1)).alias("n"))
