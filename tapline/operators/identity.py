"""Who took part: actor fingerprints, correlation keys, ladder rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from .messages import call_endpoints, call_span


def fingerprints(messages: DataFrame) -> DataFrame:
    """First non-empty banner, contact, Via and SDP origin per side of a call."""
    ends = call_endpoints(messages)
    actors = ends.select(
        "call_id",
        F.explode(
            F.array(
                F.struct(F.lit("SRC/SBC").alias("actor"), F.col("src_ip").alias("ip")),
                F.struct(F.lit("SRS/recorder").alias("actor"), F.col("srs_ip").alias("ip")),
            )
        ).alias("a"),
    ).select("call_id", "a.*").where("ip is not null")
    values = {
        "user_agent": sc.blank_to_null("user_agent"),
        "server": sc.blank_to_null("server"),
        "contact_host": sc.contact_host("contact"),
        "via_sent_by": sc.blank_to_null("via_sent_by"),
        "sdp_origin_addr": sc.sdp_origin_address("sdp_origin"),
    }
    rows = messages.select("call_id", "msg_idx", F.col("src_ip").alias("ip"), *[v.alias(n) for n, v in values.items()])
    per_ip = rows.where("ip <> ''").groupBy("call_id", "ip").agg(
        *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("msg_idx"))).alias(n) for n in values]
    )
    return actors.join(per_ip, ["call_id", "ip"], "left").select("call_id", "actor", "ip", *values)


def correlation_parts(messages: DataFrame, participants: DataFrame, streams: DataFrame) -> DataFrame:
    """Distinct (call, kind, value): AORs, media 5-tuples, SSRCs.

    Header AORs stand in only for calls whose metadata has none.
    """
    own = participants.where("coalesce(aor, '') <> ''").select("call_id", F.col("aor").alias("value"))
    headers = (
        messages.select("call_id", F.explode(F.array("from_header", "to_header")).alias("h"))
        .select("call_id", sc.aor_from_header("h").alias("value"))
        .where("value is not null")
        .join(own.select("call_id").distinct(), "call_id", "left_anti")
    )
    tuples = streams.select("call_id", sc.flow_key("src_ip", "src_port", "dst_ip", "dst_port").alias("value"))
    ssrcs = streams.where("ssrc is not null").select("call_id", sc.ssrc_hex("ssrc").alias("value"))

    def tag(df: DataFrame, kind: str) -> DataFrame:
        return df.select("call_id", F.lit(kind).alias("kind"), "value")

    return (
        tag(own.unionByName(headers), "aor")
        .unionByName(tag(tuples, "tuple"))
        .unionByName(tag(ssrcs, "ssrc"))
        .distinct()
    )


def correlation_keys(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """One key record per call with sorted lists of its distinct parts."""

    def listed(kind: str):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))

    empty = F.array().cast("array<string>")
    lists = parts.groupBy("call_id").agg(
        listed("aor").alias("participant_aors"), listed("tuple").alias("media_5tuples"), listed("ssrc").alias("ssrcs")
    )
    return (
        call_span(messages)
        .join(lists, "call_id", "left")
        .select(
            "call_id",
            sc.epoch_to_utc("start_epoch").alias("start_utc"),
            sc.epoch_to_utc("end_epoch").alias("end_utc"),
            *[F.coalesce(c, empty).alias(c) for c in ("participant_aors", "media_5tuples", "ssrcs")],
        )
    )


def ladder_rows(messages: DataFrame) -> DataFrame:
    """Per message: actors, direction, display label and raw text."""
    ep = F.struct("src_ip", "src_port", "dst_ip", "dst_port")
    invite = F.when((F.col("method") == "INVITE") & (F.coalesce("src_ip", F.lit("")) != ""), F.col("msg_idx"))
    firsts = messages.groupBy("call_id").agg(
        F.min_by(ep, invite).alias("_i"), F.min_by(ep, "msg_idx").alias("_m")
    ).select("call_id", F.coalesce("_i", "_m").alias("_e"))

    def key(ip, port):
        return F.when(port.isNotNull(), F.concat(ip, F.lit(":"), port.cast("string"))).otherwise(ip)

    mine = key(F.col("src_ip"), F.col("src_port"))
    src = key(F.col("_e.src_ip"), F.col("_e.src_port"))
    srs = key(F.col("_e.dst_ip"), F.col("_e.dst_port"))
    side = F.when(mine == src, "SRC").when(mine == srs, "SRS")
    base = F.when(
        sc.is_response(),
        F.trim(F.concat_ws(" ", F.col("status_code").cast("string"), F.coalesce("reason_phrase", F.lit("")))),
    ).otherwise(F.coalesce(sc.blank_to_null("method"), F.lit("UNKNOWN")))
    label = F.concat_ws(
        " + ", base, F.when(F.col("has_sdp"), "SDP"), F.when(F.col("has_metadata_body"), "Metadata")
    )
    raw = F.concat_ws(
        "\n",
        sc.blank_to_null("raw_headers"),
        F.when(F.coalesce("body", F.lit("")) != "", F.concat(F.lit("\n"), F.col("body"))),
    )
    return messages.join(firsts, "call_id").withColumn("_side", side).select(
        "call_id",
        F.col("msg_idx").alias("index"),
        F.col("frame_number").alias("frame"),
        F.col("t_rel").alias("time_relative"),
        F.when(F.col("_side") == "SRC", "SRC_TO_SRS")
        .when(F.col("_side") == "SRS", "SRS_TO_SRC")
        .otherwise(F.coalesce("direction", F.lit("UNKNOWN")))
        .alias("direction"),
        F.coalesce("_side", F.lit("SRC")).alias("from_actor"),
        F.when(F.col("_side") == "SRS", "SRC").otherwise("SRS").alias("to_actor"),
        sc.is_response().alias("is_response"),
        "method", "status_code", F.col("reason_phrase").alias("reason"),
        label.alias("label"), "cseq", "from_header", "to_header", "contact", "content_type",
        raw.alias("raw"),
    )
