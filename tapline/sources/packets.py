"""Capture files to packet and SIP message rows.

Two jobs: a light walk over record headers cuts every file into ranges of
records, then the ranges are spread over tasks and read. One huge capture is
thus decoded by many tasks. Frames are decoded by Spark expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import let
from ..functions.text import parse_sip_text
from ..session import parquet_stage
from .captures import index_captures
from .fragments import rejoin
from .record_walk import open_capture, records, split_start

RANGE_RECORDS = 100_000
SPLIT_BYTES = 1 << 30
BATCH_RECORDS = 4096


_RANGE = "file_idx int, file string, split bigint, offset bigint, stop bigint, n bigint, first_ts double, state string, cut bigint"
_RANGE_COLUMNS = [c.split()[0] for c in _RANGE.split(", ")]


def _walk(jobs: DataFrame, size: int) -> DataFrame:
    """Ranges of records for (file, split, begin, end) byte splits.

    A split starts at the first record boundary at or behind its begin and runs
    to the first one at or behind its end.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows: list[list] = []
                with open_capture(r.file) as f:
                    f.seek(0, 2)
                    total = f.tell()
                    begin = None if r.split == 0 else split_start(f, int(r.begin), total)
                    state: list = ["<", []]
                    at = begin if begin is not None else 0
                    last = None
                    for at, ts, caplen, origlen, _, data_at in records(f, begin, state):
                        if at >= r.end:
                            break
                        if last is None or rows[-1][5] == size:
                            rows.append([r.file_idx, r.file, r.split, at, None, 0, ts, json.dumps(state), 0])
                        rows[-1][5] += 1
                        rows[-1][8] += caplen < origlen
                        last = data_at + caplen
                    for a, b in zip(rows, rows[1:]):
                        a[4] = b[3]
                    if rows:
                        rows[-1][4] = last
                yield pd.DataFrame(rows, columns=_RANGE_COLUMNS)

    return jobs.mapInPandas(cut, _RANGE)


def record_ranges(files: DataFrame, size: int = RANGE_RECORDS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, first frame, byte offset, records, records cut off) ranges of every readable file.

    Classic captures above ``split_bytes`` are walked in byte splits by several
    tasks. Splits count only where each one ends at the byte the next begins;
    any other file is walked again as a whole.
    """
    whole = F.lit(1 << 62)
    sized = index_captures(files).where("readable")
    cuts = F.when(
        (F.col("format_hint") == "pcap") & (F.col("size_bytes") > split_bytes),
        F.sequence(F.lit(0), F.floor((F.col("size_bytes") - 1) / split_bytes).cast("int")),
    ).otherwise(F.array(F.lit(0)))
    jobs = sized.withColumn("_cuts", cuts).select(
        "file_idx", "file", "size_bytes", F.size("_cuts").alias("n_splits"), F.explode("_cuts").alias("split")
    ).select(
        "file_idx", "file", "size_bytes", "n_splits",
        F.col("split").cast("bigint").alias("split"),
        (F.col("split") * F.lit(split_bytes)).alias("begin"),
        F.when(F.col("split") < F.col("n_splits") - 1, (F.col("split") + 1) * F.lit(split_bytes)).otherwise(whole).alias("end"),
    )
    spread = files.sparkSession.sparkContext.defaultParallelism
    walked = _walk(jobs.select("file_idx", "file", "split", "begin", "end").repartition(spread, "file", "split"), size)
    found = parquet_stage(files.sparkSession)("record_ranges", walked)
    # One row per range: a huge capture has some thousand, a usual one has one.
    order = W.partitionBy("file").orderBy("offset")
    gaps = found.withColumn("_before", F.lag("stop").over(order)).where("_before <> offset").select("file")
    reach = found.groupBy("file").agg(F.max("stop").alias("_last"), F.min("split").alias("_first"))
    short = (
        jobs.where("n_splits > 1 and split = 0")
        .join(reach, "file", "left")
        .where("_last is null or _first > 0 or _last <= size_bytes - 16")
        .select("file")
    )
    torn = gaps.unionByName(short).distinct()
    again = _walk(
        jobs.where("split = 0").join(torn, "file", "left_semi").select(
            "file_idx", "file", "split", "begin", whole.alias("end")
        ),
        size,
    )
    ranges = found.join(torn, "file", "left_anti").unionByName(again)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return ranges.select(
        "file_idx", "file", "offset", "n", "state", "cut",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("first_frame"),
        F.first("first_ts").over(order).alias("first_ts"),
    )


def read_frames(ranges: DataFrame, partitions: int | None = None) -> DataFrame:
    """Records of all ranges: (file_idx, frame_number, ts_epoch, t_rel, link, frame)."""
    columns = ["file_idx", "frame_number", "ts_epoch", "t_rel", "link", "frame"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows: list[tuple] = []
                with open_capture(r.file) as f:
                    walk = records(f, int(r.offset), json.loads(r.state))
                    for k in range(int(r.n)):
                        _, ts, caplen, _, link, at = next(walk)
                        f.seek(at)
                        rows.append((r.file_idx, r.first_frame + k, ts, ts - r.first_ts, link, f.read(caplen)))
                        if len(rows) == BATCH_RECORDS:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    spread = ranges.repartition(partitions or ranges.sparkSession.sparkContext.defaultParallelism, "file", "first_frame")
    return spread.mapInPandas(
        read, "file_idx int, frame_number bigint, ts_epoch double, t_rel double, link int, frame binary"
    )


# --- decoding ------------------------------------------------------------------


def _uint(b: Column, at: Column | int, n: int) -> Column:
    """Big-endian number of n bytes at a zero-based offset; null past the end.

    Callers check the length, since a word cut short would read as a smaller one.
    """
    pos = F.lit(at + 1) if isinstance(at, int) else (at + 1).cast("int")
    return F.conv(F.hex(F.substring(b, pos, F.lit(n))), 16, 10).cast("bigint")


def _ipv4(b: Column, at: Column) -> Column:
    return F.concat_ws(".", *[_uint(b, at + i, 1).cast("string") for i in range(4)])


def _ipv6(b: Column, at: Column) -> Column:
    """Eight groups with the first longest run of zero groups shortened."""
    word = F.hex(F.substring(b, (at + 1).cast("int"), F.lit(16)))
    groups = [F.lower(F.conv(F.substring(word, 4 * i + 1, 4), 16, 16)) for i in range(8)]

    def shortened(text: Column) -> Column:
        out = text
        for run in range(2, 9):
            pattern = rf"^(.*?)(^|:)(?:0:){{{run - 1}}}0(:|$)(.*)$"
            out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1::$4")).otherwise(out)
        return out

    return let(F.concat_ws(":", *groups), shortened)


def _ip_start(b: Column, link: Column) -> Column:
    """Offset of the IP header: behind Ethernet and up to two VLAN tags, a cooked
    header, or nothing."""
    types = F.hex(F.substring(b, 13, 10))
    tagged = F.substring(types, 1, 4).isin("8100", "88A8")
    twice = tagged & F.substring(types, 9, 4).isin("8100", "88A8")
    return (
        F.when(link == 1, F.when(twice, 22).when(tagged, 18).otherwise(14))
        .when(link == 113, 16)
        .when(link == 276, 20)
        .when(link.isin(12, 101, 228, 229), 0)
    )


# IPv6 headers that another header follows, and the longest chain that is followed.
_OPTIONS, _FRAGMENT, _AUTH = (0, 43, 60), 44, 51
_CHAIN = 8
_UDP = 17


def _behind_headers(b: Column, kind: Column, at: Column) -> Column:
    """(kind, at, fragment, ident) behind the extension headers that begin with ``kind`` at ``at``.

    The walk ends behind a fragment header, whose data are those of a piece.
    """
    start = F.struct(
        kind.cast("bigint").alias("kind"), at.cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("fragment"),
        F.lit(None).cast("bigint").alias("ident"),
    )

    def step(s: Column, _: Column) -> Column:
        here, size = s["at"], _uint(b, s["at"] + 1, 1)
        after = lambda to, fragment=s["fragment"], ident=s["ident"]: F.struct(
            _uint(b, here, 1).alias("kind"), to.cast("bigint").alias("at"), fragment.alias("fragment"), ident.alias("ident")
        )
        going = s["fragment"].isNull() & (here + 8 <= F.length(b))
        return (
            F.when(going & s["kind"].isin(*_OPTIONS), after(here + (size + 1) * 8))
            .when(going & (s["kind"] == _AUTH), after(here + (size + 2) * 4))
            .when(going & (s["kind"] == _FRAGMENT), after(here + 8, _uint(b, here + 2, 2), _uint(b, here + 4, 4)))
            .otherwise(s)
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(_CHAIN)), start, step)


def decode_ip(frames: DataFrame) -> DataFrame:
    """Ethernet (with VLAN tags), raw IP and cooked captures down to the data of UDP over IP.

    ``more`` and ``at`` (bytes) are the fragment fields, 0 for whole datagrams. IPv6 extension
    headers are walked; ``proto`` is what a fragment's data begin with.
    """
    b = F.col("frame")
    ip, first = F.col("_ip"), F.col("_first")
    v4, v6 = F.floor(first / 16) == 4, F.floor(first / 16) == 6
    chained = F.col("_kind").isin(*_OPTIONS, _FRAGMENT, _AUTH)
    plain = F.struct(F.col("_kind").alias("kind"), (ip + 40).cast("bigint").alias("at"), *[F.lit(None).cast("bigint").alias(n) for n in ("fragment", "ident")])
    four = F.struct(
        _uint(b, ip + 9, 1).alias("kind"), (ip + (first % 16) * 4).cast("bigint").alias("at"), _uint(b, ip + 6, 2).alias("fragment"),
        _uint(b, ip + 4, 2).alias("ident"),
    )
    heads = (
        frames.withColumn("_ip", _ip_start(b, F.col("link")))
        .withColumn("_first", _uint(b, ip, 1))
        .withColumn("_kind", F.when(v6, _uint(b, ip + 6, 1)))
        .withColumn("_h", F.when(v4, four).when(v6 & chained, _behind_headers(b, F.col("_kind"), ip + 40)).when(v6, plain))
    )
    u, field = F.col("_h.at"), F.col("_h.fragment")
    more = F.coalesce(F.when(v4, field.bitwiseAND(0x2000)).otherwise(field.bitwiseAND(1)) > 0, F.lit(False))
    at = F.coalesce(F.when(v4, field.bitwiseAND(0x1FFF) * 8).otherwise(field.bitwiseAND(0xFFF8)), F.lit(0).cast("bigint"))
    piece = more | (at > 0)
    wanted = (F.col("_h.kind") == _UDP) | (piece & F.col("_h.kind").isin(*_OPTIONS, _AUTH) & v6)
    # Ethernet pads short frames; a length of 0 comes from offloading hosts.
    stated = F.when(v4, _uint(b, ip + 2, 2)).otherwise(_uint(b, ip + 4, 2) + 40)
    end = F.when((v4 & (stated > 0)) | (v6 & (stated > 40)), ip + stated).otherwise(F.length(b))
    return heads.where(wanted & (F.length(b) > u)).select(
        "file_idx", "frame_number", "ts_epoch", "t_rel",
        F.when(v4, _ipv4(b, ip + 12)).otherwise(_ipv6(b, ip + 8)).alias("src_ip"),
        F.when(v4, _ipv4(b, ip + 16)).otherwise(_ipv6(b, ip + 24)).alias("dst_ip"),
        F.col("_h.ident").alias("ident"), F.col("_h.kind").alias("proto"), more.alias("more"), at.alias("at"),
        F.substring(b, (u + 1).cast("int"), F.greatest(end - u, F.lit(0)).cast("int")).alias("data"),
    )


def whole_datagrams(data: DataFrame) -> DataFrame:
    """Rows of ``decode_ip`` with their fragments rejoined; incomplete datagrams go."""
    fragment = F.col("more") | (F.col("at") > 0)
    joined = rejoin(data.where(fragment))
    # Headers that follow the fragment header are part of what was cut.
    inner = joined.withColumn("_h", F.when(F.col("proto") != _UDP, _behind_headers(F.col("data"), F.col("proto"), F.lit(0))))
    inner = inner.where("proto = 17 or _h.kind = 17").withColumn("data", F.when(F.col("_h").isNull(), F.col("data")).otherwise(F.expr("substring(data, cast(_h.at + 1 as int))")))
    return data.where(~fragment).unionByName(inner.select(*data.columns))


def udp_of(datagrams: DataFrame) -> DataFrame:
    """Ports and payloads of whole IP datagrams."""
    d = F.col("data")
    size = F.greatest(_uint(d, 4, 2) - 8, F.lit(0))
    return datagrams.where(F.length(d) >= 8).select(
        "file_idx", "frame_number", "ts_epoch", "t_rel", "src_ip", _uint(d, 0, 2).cast("int").alias("src_port"),
        "dst_ip", _uint(d, 2, 2).cast("int").alias("dst_port"), F.substring(d, F.lit(9), size.cast("int")).alias("payload"),
    )


def decode_udp(frames: DataFrame) -> DataFrame:
    """UDP payloads of all frames, fragments rejoined; ``frames`` should be a stored table."""
    return udp_of(whole_datagrams(decode_ip(frames)))


def _rtcp_parts(p: Column) -> Column:
    """Offsets, types and counts of the packets in a compound RTCP datagram."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.array().cast("array<struct<at:bigint,pt:bigint,n:bigint>>").alias("parts"),
    )
    steps = F.sequence(F.lit(1), F.greatest(F.floor(F.length(p) / 4).cast("int"), F.lit(1)))

    def step(s: Column, _: Column) -> Column:
        ok = (s["at"] + 4 <= F.length(p)) & (F.floor(_uint(p, s["at"], 1) / 64) == 2)
        part = F.struct(
            s["at"].alias("at"), _uint(p, s["at"] + 1, 1).alias("pt"), (_uint(p, s["at"], 1) % 32).alias("n")
        )
        return F.when(
            ok,
            F.struct(
                (s["at"] + (_uint(p, s["at"] + 2, 2) + 1) * 4).alias("at"), F.array_append(s["parts"], part).alias("parts")
            ),
        ).otherwise(F.struct(F.length(p).cast("bigint").alias("at"), s["parts"].alias("parts")))

    return F.aggregate(steps, start, step)["parts"]


def _joined(xs: Column) -> Column:
    return F.array_join(F.transform(xs, lambda x: x.cast("string")), ",")


def decode_media(udp: DataFrame) -> DataFrame:
    """RTP and RTCP datagrams to the packets table.

    The second byte tells them apart: 192-223 is an RTCP packet type.
    """
    p = F.col("payload")
    lead = F.hex(F.substring(p, 1, 2))
    versioned = F.substring(lead, 1, 1).isin("8", "9", "A", "B")
    second = F.col("_second")
    rtcp = second.between(192, 223)
    parts = F.when(rtcp, _rtcp_parts(p))
    reports = F.filter(F.col("_parts"), lambda x: x["pt"].isin(200, 201))
    blocks = F.flatten(
        F.transform(
            reports,
            lambda x: F.when(
                x["n"] > 0,
                F.transform(
                    F.sequence(F.lit(0), (x["n"] - 1).cast("int")),
                    lambda i: x["at"] + F.when(x["pt"] == 200, 28).otherwise(8) + i * 24,
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        )
    )
    blocks = F.filter(blocks, lambda at: at + 24 <= F.length(p))
    byes = F.flatten(
        F.transform(
            F.filter(F.col("_parts"), lambda x: x["pt"] == 203),
            lambda x: F.when(
                x["n"] > 0,
                F.transform(F.sequence(F.lit(0), (x["n"] - 1).cast("int")), lambda i: x["at"] + 4 + i * 4),
            ).otherwise(F.array().cast("array<bigint>")),
        )
    )
    hex_id = lambda at: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(_uint(p, at, 4))), 8, "0"))
    ids = F.transform(F.concat(F.col("_blocks"), F.filter(byes, lambda at: at + 4 <= F.length(p))), hex_id)
    return (
        udp.where(versioned & (F.length(p) >= 4))
        .withColumn("_second", _uint(p, 1, 1))
        .where(rtcp | (F.length(p) >= 12))
        .withColumn("_parts", parts)
        .withColumn("_blocks", F.coalesce(blocks, F.array().cast("array<bigint>")))
        .select(
            "file_idx", "frame_number", "ts_epoch", "t_rel", "src_ip", "src_port", "dst_ip", "dst_port",
            F.when(~rtcp, _uint(p, 8, 4)).alias("ssrc"),
            F.when(~rtcp, _uint(p, 2, 2).cast("int")).alias("seq"),
            F.when(~rtcp, (second % 128).cast("int")).alias("p_type"),
            F.coalesce(_joined(F.transform("_parts", lambda x: x["pt"])), F.lit("")).alias("rtcp_pt"),
            F.coalesce(F.array_join(ids, ","), F.lit("")).alias("rtcp_ids"),
            F.coalesce(_joined(F.transform("_blocks", lambda a: _uint(p, a + 4, 1))), F.lit("")).alias("rtcp_fraction"),
            F.coalesce(_joined(F.transform("_blocks", lambda a: _uint(p, a + 5, 3))), F.lit("")).alias("rtcp_cumulative"),
            F.coalesce(_joined(F.transform("_blocks", lambda a: _uint(p, a + 12, 4))), F.lit("")).alias("rtcp_jitter"),
        )
    )


def decode_sip(udp: DataFrame) -> DataFrame:
    """Datagrams that start with a SIP start line, parsed to message rows."""
    text = F.make_valid_utf8(F.col("payload").cast("string"))
    start = F.decode(F.substring("payload", 1, 8), "ISO-8859-1")
    rows = udp.where(start.rlike(r"^(SIP/2\.0|[A-Z]{3,} ?)")).withColumn("_s", parse_sip_text(text))
    return rows.where("_s.error is null and _s.call_id is not null").select(
        "file_idx", "frame_number", "ts_epoch", "t_rel", "src_ip", "src_port", "dst_ip", "dst_port",
        F.lit("UNKNOWN").alias("direction"),
        *[
            F.col(f"_s.{c}").alias(c)
            for c in (
                "call_id", "method", "status_code", "reason_phrase", "cseq", "from_header", "to_header", "contact",
                "content_type", "raw_headers", "body", "user_agent", "server", "via_branch", "via_sent_by",
            )
        ],
    )


def read_packets(
    files: DataFrame, size: int = RANGE_RECORDS, split_bytes: int = SPLIT_BYTES, ranges: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(packets, SIP message rows) of listed captures, as stored tables.

    The captures are read once; media and messages are both taken from the stored datagrams.
    ``ranges`` are those of ``record_ranges`` where they are at hand.
    """
    keep = parquet_stage(files.sparkSession)
    ranges = ranges if ranges is not None else record_ranges(files, size, split_bytes)
    data = keep("datagrams", decode_ip(read_frames(ranges)))
    udp = udp_of(whole_datagrams(data))
    return keep("packets", decode_media(udp)), keep("sip", decode_sip(udp))

