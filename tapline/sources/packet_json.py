"""JSON packet exports of SIP traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from .fields import BROADCAST_FILES, file_index

# The names of the fields that are read.
_FIELDS = (
    "frame.number", "frame.time_epoch", "frame.time_relative", "ip.src", "ipv6.src", "ip.dst", "ipv6.dst", "udp.srcport", "tcp.srcport",
    "udp.dstport", "tcp.dstport", "sip.Call-ID", "sip.Method", "sip.Status-Code", "sip.Reason-Phrase", "sip.Status-Line", "sip.CSeq", "sip.From",
    "sip.To", "sip.Contact", "sip.Content-Type", "sip.msg_hdr", "sip.msg_body", "sip.User-Agent", "sip.Server", "sip.Via.branch",
    "sip.Via.sent_by", "sip.Via",
)
# The layers of a packet that is given without an envelope.
_LAYERS = ("frame", "ip", "ipv6", "udp", "tcp", "sip")

# A wanted name, a colon and a string. Loops are possessive, so Java neither recurses nor
# backtracks in them: the stack stays flat for strings of any length.
_VALUE = r'"\s*+:\s*+"((?:[^"\\]++|\\.)*+)"'
_PAIR = r'(?s)"(' + "|".join(n.replace(".", r"\.") for n in _FIELDS) + ")" + _VALUE


def string_fields(text: Column) -> Column:
    """(name, raw string) of every wanted field with a string value, in the order of the JSON text.

    Quotes inside JSON strings are escaped, so a quoted name before a colon is always a key, at
    any depth; list elements have no name and never match.
    """
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(_PAIR), 1).alias("name"), F.regexp_extract_all(text, F.lit(_PAIR), 2).alias("raw"))


def messages_of_packets(packets: DataFrame) -> DataFrame:
    """(file, packet) JSON objects to SIP message rows; other packets drop out.

    A field counts with its first string value in the layer tree.
    """
    sip_only = packets.where(F.col("packet").contains('"sip.'))
    layers = F.coalesce(F.get_json_object("packet", "$._source.layers"), F.col("packet"))
    present = F.col("_layers").rlike(r'(?s)"sip\.(?:Call-ID|msg_hdr|Method)' + _VALUE)
    rows = sip_only.select("file", layers.alias("_layers")).where(present).select("file", string_fields(F.col("_layers")).alias("_all"))
    # Of each name the first one; there are no more entries than names.
    first = F.aggregate(
        "_all",
        F.array().cast("array<struct<name:string,raw:string>>"),
        lambda kept, x: F.when(F.exists(kept, lambda y: y["name"] == x["name"]), kept).otherwise(F.array_append(kept, x)),
    )
    rows = rows.select("file", F.map_from_entries(first).alias("_fields"))

    def field(name: str):
        raw = F.col("_fields")[name]
        unescaped = F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>")[0]
        return F.when(raw.contains("\\"), unescaped).otherwise(raw)

    def either(*names: str):
        return F.coalesce(*[sc.blank_to_null(field(n)) for n in names])

    return rows.select(
        "file",
        field("sip.Call-ID").alias("call_id"),
        F.coalesce(sc.parse_int(field("frame.number")), F.lit(0)).alias("frame_number"),
        sc.parse_float(field("frame.time_epoch")).alias("ts_epoch"),
        sc.parse_float(field("frame.time_relative")).alias("t_rel"),
        F.coalesce(either("ip.src", "ipv6.src"), F.lit("")).alias("src_ip"),
        sc.parse_int(either("udp.srcport", "tcp.srcport")).cast("int").alias("src_port"),
        F.coalesce(either("ip.dst", "ipv6.dst"), F.lit("")).alias("dst_ip"),
        sc.parse_int(either("udp.dstport", "tcp.dstport")).cast("int").alias("dst_port"),
        F.lit("UNKNOWN").alias("direction"),
        F.upper(sc.blank_to_null(field("sip.Method"))).alias("method"),
        sc.parse_int(field("sip.Status-Code")).cast("int").alias("status_code"),
        F.coalesce(sc.blank_to_null(field("sip.Reason-Phrase")), field("sip.Status-Line")).alias("reason_phrase"),
        field("sip.CSeq").alias("cseq"),
        field("sip.From").alias("from_header"),
        field("sip.To").alias("to_header"),
        field("sip.Contact").alias("contact"),
        field("sip.Content-Type").alias("content_type"),
        F.coalesce(field("sip.msg_hdr"), F.lit("")).alias("raw_headers"),
        sc.blank_to_null(field("sip.msg_body")).alias("body"),
        field("sip.User-Agent").alias("user_agent"),
        field("sip.Server").alias("server"),
        field("sip.Via.branch").alias("via_branch"),
        F.coalesce(sc.blank_to_null(field("sip.Via.sent_by")), field("sip.Via")).alias("via_sent_by"),
    )


def read_packet_json(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """JSON exports below a path to SIP message rows with their file index.

    An array export is parsed element by element, one row each, in one task a file;
    ``json_lines`` (one packet per line) splits within files and is the form for large exports.
    Compressed files of either form are read by one task each. Up to ``BROADCAST_FILES`` files
    their index is broadcast and no message is shuffled with its body, beyond that Spark chooses.
    """
    if json_lines:
        packets = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("value").alias("packet")
        )
    else:
        columns = ["_source", "layers", *_LAYERS, *_FIELDS]
        objects = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).json(path, multiLine=True)
        # Without an envelope the layers are put together again, or the fields themselves.
        bare = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.col(n)) for n in _LAYERS])
        flat = F.to_json(F.struct(*[F.col(f"`{n}`") for n in _FIELDS]))
        whole = F.coalesce("_source", "layers", F.concat(F.lit("{"), F.nullif(bare, F.lit("")), F.lit("}")), flat)
        packets = objects.select(F.col("_metadata.file_path").alias("file"), whole.alias("packet"))
    rows = messages_of_packets(packets)
    index = file_index(rows)
    if spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path")).count() <= BROADCAST_FILES:
        index = F.broadcast(index)
    return rows.join(index, "file").drop("file")
