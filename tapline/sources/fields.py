"""Tab-separated packet-field exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as sc
from .record_walk import open_capture

HEADER_CHUNK = 1 << 16
#: Most files whose header lines (some hundred bytes each) are broadcast.
BROADCAST_FILES = 20_000

# Export field -> column. Absent fields become empty text.
FIELDS = {
    "frame.number": "frame_number",
    "frame.time_epoch": "ts_epoch",
    "frame.time_relative": "t_rel",
    "ip.src": "ip_src",
    "ip.dst": "ip_dst",
    "ipv6.src": "ipv6_src",
    "ipv6.dst": "ipv6_dst",
    "udp.srcport": "src_port",
    "udp.dstport": "dst_port",
    "rtp.ssrc": "rtp_ssrc",
    "rtp.seq": "rtp_seq",
    "rtp.p_type": "rtp_p_type",
    "rtcp.pt": "rtcp_pt",
    "rtcp.ssrc.identifier": "rtcp_ids",
    "rtcp.ssrc.fraction": "rtcp_fraction",
    "rtcp.ssrc.cumulative": "rtcp_cumulative",
    "rtcp.ssrc.jitter": "rtcp_jitter",
}


def file_index(files: DataFrame) -> DataFrame:
    """Number files by their base name; one row per file, never per packet."""
    names = files.select("file").distinct()
    base = F.element_at(F.split("file", "/"), -1)
    return names.select("file", (F.row_number().over(W.orderBy(base, "file")) - 1).alias("file_idx"))


def read_headers(files: DataFrame) -> DataFrame:
    """(file, header line) of (file): line 1, whatever its names look like.

    Only the beginning of each file is read. Empty files have no row; a file that
    begins with a blank line is an error.
    """

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path in pdf.file:
                with open_capture(path) as f:
                    head = b""
                    while b"\n" not in head and (more := f.read(HEADER_CHUNK)):
                        head += more
                line = head.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8", "replace")
                if head and not line.strip():
                    raise ValueError(f"no header line in {path}")
                found.append(line or None)
            yield pdf.assign(header_line=found).dropna()

    return files.mapInPandas(first_lines, "file string, header_line string")


def rows_of_lines(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, value) text lines to one row of text columns per packet.

    ``headers`` is (file, header_line). Every file names its own columns, so exports of
    different tool versions mix: short rows are padded and missing fields empty.
    """
    named = headers.select(F.col("file").alias("_of"), "header_line", F.split("header_line", "\t").alias("header"))
    joined = lines.join(named, lines["file"] == named["_of"])
    body = joined.where((F.col("value") != F.col("header_line")) & (F.trim("value") != ""))
    body = body.select("file", "header", F.split("value", "\t").alias("cells"))

    def cell(field: str):
        at = F.array_position("header", F.lit(field)).cast("int")
        return F.coalesce(F.try_element_at("cells", F.nullif(at, F.lit(0))), F.lit(""))

    return body.select("file", *[cell(f).alias(c) for f, c in FIELDS.items()])


def read_field_rows(spark: SparkSession, path: str) -> DataFrame:
    """All field exports below a path as text rows with their file.

    One row per file goes into the join with the lines: up to ``BROADCAST_FILES`` files it
    is broadcast and no line is shuffled, beyond that Spark chooses.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    headers = read_headers(files)
    if files.count() <= BROADCAST_FILES:
        headers = F.broadcast(headers)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows_of_lines(lines, headers)


def typed_packets(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Text rows to the packets table; unreadable numbers become null."""
    index = file_index(rows) if files is None else files

    def address(v4: str, v6: str):
        return F.coalesce(sc.blank_to_null(v4), sc.blank_to_null(v6), F.lit(""))

    return rows.join(index, "file").select(
        F.col("file_idx").cast("int").alias("file_idx"),
        F.coalesce(sc.parse_int("frame_number"), F.lit(0)).alias("frame_number"),
        sc.parse_float("ts_epoch").alias("ts_epoch"),
        sc.parse_float("t_rel").alias("t_rel"),
        address("ip_src", "ipv6_src").alias("src_ip"),
        sc.parse_int("src_port").cast("int").alias("src_port"),
        address("ip_dst", "ipv6_dst").alias("dst_ip"),
        sc.parse_int("dst_port").cast("int").alias("dst_port"),
        sc.parse_int("rtp_ssrc").alias("ssrc"),
        sc.parse_int("rtp_seq").cast("int").alias("seq"),
        sc.parse_int("rtp_p_type").cast("int").alias("p_type"),
        "rtcp_pt", "rtcp_ids", "rtcp_fraction", "rtcp_cumulative", "rtcp_jitter",
    )
