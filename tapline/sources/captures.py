"""Capture files: listing, header index, custody and quality."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fields import file_index
from .record_walk import declared_snaplen, open_capture

# Capture suffixes and header magics.
SUFFIXES = ("pcap", "pcapng", "cap")
CLASSIC_BIG = ("A1B2C3D4", "A1B23C4D")
CLASSIC_LITTLE = ("D4C3B2A1", "4D3CB2A1")
CLASSIC_NANOS = ("A1B23C4D", "4D3CB2A1")
PCAPNG = "0A0D0D0A"
UNREADABLE = "Unrecognized capture format header."
HEAD_BYTES = 40
HASH_CHUNK = 1 << 20


def list_captures(spark: SparkSession, path: str, directory: bool = False) -> DataFrame:
    """Capture files of a path or glob, in base-name order.

    For a directory only the known suffixes count. File contents are not read.
    """
    files = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"), F.col("length").alias("size_bytes")
    )
    if directory:
        suffix = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
        files = files.where(suffix.isin(*SUFFIXES))
    if files.isEmpty():
        raise FileNotFoundError(f"no capture files found for {path!r}")
    return files.join(file_index(files), "file").orderBy("file_idx")


def read_heads(files: DataFrame) -> DataFrame:
    """First bytes of each file (null and an error text when it cannot be opened)."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, errors = [], []
            for path in pdf.file:
                try:
                    with open_capture(path) as f:
                        found.append(f.read(HEAD_BYTES))
                        errors.append(None)
                except OSError as exc:
                    found.append(None)
                    errors.append(str(exc))
            yield pdf.assign(head=found, read_error=errors)

    return files.mapInPandas(
        heads, "file string, size_bytes bigint, file_idx int, head binary, read_error string"
    )


def decode_heads(heads: DataFrame) -> DataFrame:
    """Format, first packet time, readability and error from the header bytes."""
    magic = F.hex(F.substring("head", 1, 4))
    big = magic.isin(*CLASSIC_BIG)
    classic = big | magic.isin(*CLASSIC_LITTLE)

    def number(at: int):
        word = F.hex(F.substring("head", at, 4))
        pairs = [F.substring(word, i, 2) for i in (7, 5, 3, 1)]
        return F.conv(F.when(big, word).otherwise(F.concat(*pairs)), 16, 10).cast("double")

    unit = F.when(magic.isin(*CLASSIC_NANOS), F.lit(1e9)).otherwise(F.lit(1e6))
    hint = F.when(magic == PCAPNG, "pcapng").when(classic, "pcap")
    first = F.when(classic & (F.length("head") >= HEAD_BYTES), number(25) + number(29) / unit)
    return heads.select(
        *[c for c in heads.columns if c not in ("head", "read_error")],
        hint.alias("format_hint"),
        first.alias("first_packet_time"),
        hint.isNotNull().alias("readable"),
        F.coalesce("read_error", F.when(hint.isNull(), F.lit(UNREADABLE))).alias("error"),
    )


def index_captures(files: DataFrame) -> DataFrame:
    return decode_heads(read_heads(files.select("file", "size_bytes", F.col("file_idx").cast("int"))))


def file_digests(files: DataFrame) -> DataFrame:
    """SHA-256 and declared snap length of each file; one task streams one file in fixed memory."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for idx, path in zip(pdf.file_idx, pdf.file):
                digest, snap, error = hashlib.sha256(), None, None
                try:
                    with open_capture(path) as f:
                        snap = declared_snaplen(f)
                        f.seek(0)
                        while chunk := f.read(HASH_CHUNK):
                            digest.update(chunk)
                except OSError as exc:
                    error = str(exc)
                rows.append((idx, path, None if error else digest.hexdigest(), snap, error))
            yield pd.DataFrame(rows, columns=["file_idx", "file", "sha256", "snaplen", "error"]).astype({"snaplen": "Int64"})

    spread = files.select(F.col("file_idx").cast("int").alias("file_idx"), "file").repartition("file")
    return spread.mapInPandas(measure, "file_idx int, file string, sha256 string, snaplen bigint, error string")


def file_quality(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """SHA-256, record counts, snap length and truncation of each file.

    Counts and truncation are sums over the record ranges (``packets.record_ranges``) of the one
    walk that also reads the packets, so large files are counted by many tasks.
    """
    counted = ranges.groupBy("file").agg(F.sum("n").alias("n_records"), (F.sum("cut") > 0).alias("truncated"))
    return file_digests(files).join(counted, "file", "left").select(
        "file_idx", "file", "sha256", F.coalesce("n_records", F.lit(0)).alias("n_records"), "snaplen",
        F.coalesce("truncated", F.lit(False)).alias("truncated"), "error",
    )


def capture_quality(per_file: DataFrame, call_files: DataFrame, drops: DataFrame | None = None) -> DataFrame:
    """Per call: any truncation, snap length of the last file, summed drops, files.

    ``drops`` is (file_idx, drops) where a capture-information report gave them.
    """
    rows = call_files.select("call_id", "file_idx").distinct().join(per_file, "file_idx")
    if drops is None:
        rows = rows.withColumn("drops", F.lit(None).cast("bigint"))
    else:
        rows = rows.join(drops.select("file_idx", "drops"), "file_idx", "left")
    return rows.groupBy("call_id").agg(
        F.bool_or("truncated").alias("truncated"),
        F.max_by("snaplen", F.when(F.col("snaplen").isNotNull(), F.col("file_idx"))).alias("snaplen"),
        F.sum("drops").alias("drop_count"),
        F.count(F.lit(1)).alias("n_files"),
        F.count("error").alias("n_unreadable"),
    )
