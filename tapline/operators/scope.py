"""Which packets belong to which call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import infer_rtcp_port

# Payload types in this range are RTCP on the media port (RFC 5761).
MUX_RANGE = (64, 95)

# Seconds of a slot on the lowest level of the time index, slots of a level in one of the next, levels.
SLOT_S = 3600.0
RADIX = 16
LEVELS = 12

# Parts the packets of a file are dealt into where they meet every call of the file, and lists its calls stand in.
SLICES = 128
CALL_LISTS = 16
# What tells packets of a file apart, as far as a table has it; texts are left out, they cost more than the deal.
DEALT_BY = ("frame_number", "ts_epoch", "seq", "src_port", "dst_port")


def is_mux_type(p_type: str = "p_type"):
    return F.coalesce(F.col(p_type).between(*MUX_RANGE), F.lit(False))


def is_rtcp(rtcp_pt: str = "rtcp_pt"):
    return F.coalesce(F.col(rtcp_pt) != "", F.lit(False))


def call_ports(media: DataFrame) -> DataFrame:
    """Distinct RTP and RTCP ports a call announced in any SDP; port 0 is none."""
    both = F.array("port", infer_rtcp_port("port", "rtcp_port", "rtcp_mux"))
    return (
        media.select("call_id", F.explode(both).alias("port"))
        .where("port is not null and port <> 0")
        .distinct()
    )


def _laid_out(windows: DataFrame) -> DataFrame:
    """``windows`` (_from, _to) with one row for each slot that a window meets on its own level.

    The slots of a level are ``RADIX`` times as long as those of the level below. A window lies
    on the lowest level on which it meets at most RADIX + 1 slots, so it costs no more rows
    however long it is, and on any level but the lowest it fills a good part of its slots.
    """
    hours = F.floor(F.col("_to") / SLOT_S) - F.floor(F.col("_from") / SLOT_S)
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(hours < float(RADIX) ** (k + 1), F.lit(k)).otherwise(level)
    sized = windows.withColumn("_level", level).withColumn("_size", F.lit(SLOT_S) * F.pow(F.lit(float(RADIX)), F.col("_level")))
    slots = F.sequence(F.floor(F.col("_from") / F.col("_size")).cast("bigint"), F.floor(F.col("_to") / F.col("_size")).cast("bigint"))
    return sized.withColumn("_slot", F.explode(slots)).drop("_size")


def _met(packets: DataFrame, windows: DataFrame, on: list[str]) -> DataFrame:
    """Packets joined with the windows of their ``on`` values that hold their time.

    A packet looks up one slot on each level that is in use: one, as a rule, and LEVELS at most.
    """
    laid = _laid_out(windows.where("_from <= _to"))
    levels = sorted(r[0] for r in laid.select("_level").distinct().collect())
    places = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("ts_epoch") / (SLOT_S * float(RADIX) ** k)).cast("bigint").alias("slot")) for k in levels])
    if not levels:
        return packets.join(laid.limit(0), on)
    placed = packets.withColumn("_place", F.explode(places)).withColumns({"_level": F.col("_place.level"), "_slot": F.col("_place.slot")}).drop("_place")
    return placed.join(laid, [*on, "_level", "_slot"]).where(F.col("ts_epoch").between(F.col("_from"), F.col("_to")))


def _windows(spans: DataFrame, slack: float) -> DataFrame:
    return spans.select("call_id", (F.col("start_epoch") - slack).alias("_from"), (F.col("end_epoch") + slack).alias("_to"))


def _match_ports(packets: DataFrame, ports: DataFrame, spans: DataFrame | None, slack: float) -> DataFrame:
    """Packets with every call one of whose ports they use, once per call.

    The ports of a call stand beside each of them: 16-bit numbers, so at most 65,535 entries.
    """
    lists = ports.groupBy("call_id").agg(F.collect_set("port").alias("_ports"))
    dim = ports.join(lists, "call_id")
    sides = F.array(
        F.struct(F.col("src_port").alias("port"), F.lit(True).alias("by_src")),
        F.struct(F.col("dst_port").alias("port"), F.lit(False).alias("by_src")),
    )
    keyed = packets.withColumn("_s", F.explode(sides)).select(
        *packets.columns, F.col("_s.port").alias("port"), F.col("_s.by_src").alias("_by_src")
    ).where("port is not null")
    once = F.col("_by_src") | F.col("src_port").isNull() | ~F.array_contains("_ports", F.col("src_port"))
    if spans is None:
        found = keyed.join(dim, "port")
    else:
        found = _met(keyed, dim.join(_windows(spans, slack), "call_id"), ["port"])
    return found.where(once).select("call_id", *packets.columns)


def _of_files(packets: DataFrame, calls: DataFrame) -> DataFrame:
    """Packets with every one of the ``calls`` (call_id, file_idx) of their file.

    The rows are packets times calls, so a file's packets are dealt over slices, each a task of
    its own however few bytes it reads, and the file's calls arrive there as lists. A file and a
    slice are one number: the only key of the join, by which the packets lie as they were dealt.
    With two, a file that is the same in all rows drops out of the keys, and the packets are
    shuffled once more, into as few tasks as their bytes ask for.
    """
    first = F.col("file_idx").cast("bigint") * SLICES
    lists = calls.groupBy("file_idx", F.pmod(F.xxhash64("call_id"), F.lit(CALL_LISTS)).alias("_list")).agg(F.collect_list(F.struct("call_id")).alias("_calls"))
    lists = lists.select(F.explode(F.sequence(first, first + (SLICES - 1))).alias("_slice"), F.transform("_calls", lambda c: c["call_id"]).alias("_calls"))
    place = F.pmod(F.xxhash64(*[c for c in DEALT_BY if c in packets.columns]), F.lit(SLICES))
    parts = max(2 * SLICES, int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = packets.withColumn("_slice", first + place).repartition(parts, "_slice")
    return dealt.join(lists.hint("merge"), "_slice").select(F.explode("_calls").alias("call_id"), *packets.columns)


def scope_media_to_calls(
    packets: DataFrame,
    ports: DataFrame,
    spans: DataFrame | None = None,
    call_files: DataFrame | None = None,
    slack_seconds: float = 60.0,
) -> DataFrame:
    """Give every RTP/RTCP packet the calls whose ports it uses.

    A packet matches on its source or its destination port and is kept once
    per call: the destination match is dropped where the source port belongs to
    the same call, so no duplicate removal has to shuffle the packets.

    ``spans`` (call_id, start_epoch, end_epoch) also bounds the match in time,
    which keeps port reuse across a long archive from multiplying rows. Packets
    and calls without an absolute time match on the port alone.
    ``call_files`` (call_id, file_idx; calls that announced no port) gives such
    calls all media of the capture files that carry their signalling, with
    ``spans`` only what lies in the call's span.
    """
    if spans is None:
        out = _match_ports(packets, ports, None, slack_seconds)
    else:
        known = spans.where("start_epoch is not null and end_epoch is not null")
        timed, untimed = packets.where("ts_epoch is not null"), packets.where("ts_epoch is null")
        of_known = ports.join(known.select("call_id"), "call_id", "left_semi")
        out = (
            _match_ports(timed, of_known, known, slack_seconds)
            .unionByName(_match_ports(untimed, of_known, None, slack_seconds))
            .unionByName(_match_ports(packets, ports.join(known.select("call_id"), "call_id", "left_anti"), None, slack_seconds))
        )
    if call_files is not None:
        wanted = call_files.select("call_id", "file_idx").distinct()

        if spans is None:
            out = out.unionByName(_of_files(packets, wanted))
        else:
            of_known = wanted.join(known.select("call_id"), "call_id", "left_semi")
            in_time = _met(timed, of_known.join(_windows(known, slack_seconds), "call_id"), ["file_idx"]).select("call_id", *packets.columns)
            out = out.unionByName(in_time).unionByName(_of_files(untimed, of_known))
            out = out.unionByName(_of_files(packets, wanted.join(known.select("call_id"), "call_id", "left_anti")))
    return out


def scoped_counts(packets: DataFrame, ports: DataFrame, call_files: DataFrame | None = None) -> DataFrame:
    """Packets ``n``, distinct ``frames`` and ``rtcp`` packets that ``scope_media_to_calls`` gives each call.

    Packets of the same ports, for calls without ports those of the same file, have the same
    calls, so their counts are scoped in place of the packets. A frame number that stands under
    one pair of ports (in one file) is counted there; the others are scoped one by one, and each
    counts once a call. ``call_files`` are calls that have no row in ``ports``.
    """
    none = F.lit(None).cast("int")
    frames = packets.select("file_idx", "src_port", "dst_port", "frame_number", is_rtcp().alias("_r"))
    sides = [(["src_port", "dst_port"], lambda rows: scope_media_to_calls(rows.withColumn("file_idx", none), ports))]
    if call_files is not None:
        unported = call_files.where("file_idx is not null")
        sides.append((["file_idx"], lambda rows: scope_media_to_calls(rows.withColumns({"src_port": none, "dst_port": none}), ports, call_files=unported)))
    parts = []
    for keys, scoped in sides:
        each = frames.groupBy("frame_number", *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("_r").alias("rtcp"))
        doubled = each.where("frame_number is not null").groupBy("frame_number").agg(F.count(F.lit(1)).alias("_places")).where("_places > 1").select("frame_number", F.lit(True).alias("_doubled"))
        told = each.join(doubled, "frame_number", "left").withColumn("_doubled", F.coalesce("_doubled", F.lit(False)))
        once = F.count_if(F.col("frame_number").isNotNull() & ~F.col("_doubled")).alias("frames")
        sums = scoped(told.groupBy(*keys).agg(F.sum("n").alias("n"), once, F.sum("rtcp").alias("rtcp")))
        again = scoped(told.where("_doubled").select(*keys, "frame_number")).select("call_id", "frame_number").distinct()
        zero = F.lit(0).cast("bigint")
        parts += [sums.select("call_id", "n", "frames", "rtcp"), again.groupBy("call_id").agg(zero.alias("n"), F.count(F.lit(1)).alias("frames"), zero.alias("rtcp"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("call_id").agg(*[F.sum(c).alias(c) for c in ("n", "frames", "rtcp")])


def calls_without_ports(messages: DataFrame, ports: DataFrame) -> DataFrame:
    """(call_id, file_idx) of calls that announced no media port."""
    return (
        messages.select("call_id", "file_idx")
        .distinct()
        .join(ports.select("call_id").distinct(), "call_id", "left_anti")
    )


def focused_packets(messages: DataFrame, scoped: DataFrame) -> DataFrame:
    """All packets of a call: its signalling and its media, one row each."""
    sip = messages.select(
        "call_id", "file_idx", "frame_number", "ts_epoch", F.lit("sip").alias("kind"),
        "src_ip", "src_port", "dst_ip", "dst_port",
    )
    media = scoped.select(
        "call_id", "file_idx", "frame_number", "ts_epoch",
        F.when(is_rtcp(), F.lit("rtcp")).otherwise(F.lit("rtp")).alias("kind"),
        "src_ip", "src_port", "dst_ip", "dst_port",
    )
    return sip.unionByName(media)
