"""Golden-call profiles and the difference of other calls to one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sdp as sdp_fn
from .findings import finding, words


def codec_lines(messages: DataFrame) -> DataFrame:
    """Payload list of every audio/video line, as text, in message order."""
    return (
        messages.select("call_id", "msg_idx", F.explode("media").alias("m"))
        .where(F.col("m.media_type").isin(*sdp_fn.MEDIA_TYPES) & (F.size("m.payload_types") > 0))
        .select("call_id", "msg_idx", F.col("m.media_idx").alias("media_idx"), F.col("m.payload_types").alias("payloads"))
    )


def call_profiles(
    messages: DataFrame, snapshots: DataFrame, streams: DataFrame, fingerprints: DataFrame
) -> DataFrame:
    """One comparable profile per call; codec sets are kept distinct and sorted."""
    base = messages.select("call_id").distinct()
    declared = snapshots.groupBy("call_id").agg(F.sum("n_streams").cast("bigint").alias("declared_streams"))
    seen = streams.groupBy("call_id").agg(F.count(F.lit(1)).alias("observed_streams"))
    codecs = codec_lines(messages).groupBy("call_id").agg(F.array_sort(F.collect_set("payloads")).alias("codec_sets"))
    dirs = (
        messages.select("call_id", F.explode("media").alias("m"))
        .where("coalesce(m.direction, '') <> ''")
        .groupBy("call_id")
        .agg(F.array_sort(F.collect_set("m.direction")).alias("media_directions"))
    )
    banner = F.coalesce(F.nullif("user_agent", F.lit("")), F.nullif("server", F.lit("")))
    banners = fingerprints.groupBy("call_id").agg(F.array_sort(F.collect_set(banner)).alias("fingerprint_banners"))
    return (
        base.join(declared, "call_id", "left")
        .join(seen, "call_id", "left")
        .join(codecs, "call_id", "left")
        .join(dirs, "call_id", "left")
        .join(banners, "call_id", "left")
        .select(
            "call_id",
            F.coalesce("declared_streams", F.lit(0)).alias("declared_streams"),
            F.coalesce("observed_streams", F.lit(0)).alias("observed_streams"),
            F.coalesce("codec_sets", F.array().cast("array<array<string>>")).alias("codec_sets"),
            F.col("declared_streams").isNotNull().alias("metadata_present"),
            F.coalesce("fingerprint_banners", F.array().cast("array<string>")).alias("fingerprint_banners"),
            F.coalesce("media_directions", F.array().cast("array<string>")).alias("media_directions"),
        )
    )


def _python_bool(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def _python_list(c: Column) -> Column:
    return F.when(F.size(c) == 0, "[]").otherwise(
        F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))
    )


def diff_against_baseline(profiles: DataFrame, baseline: DataFrame) -> DataFrame:
    """Differences of every call to one saved profile (a one-row table).

    The profile's fields enter as scalar subqueries, so nothing is joined.
    """
    def field(name: str) -> Column:
        return baseline.select(name).scalar()

    p = profiles
    for name in ("declared_streams", "observed_streams", "metadata_present", "codec_sets", "media_directions"):
        p = p.withColumn(f"base_{name}", field(name))

    def pair(order: int, what: str, name: str, text) -> DataFrame:
        return finding(
            p.where(~F.col(f"base_{name}").eqNullSafe(F.col(name))), order, "BASELINE_DIFF", "WARN",
            f"Differs from baseline: {what}",
            words(f"Baseline {what} = ", text(F.col(f"base_{name}")), "; this call = ", text(F.col(name)), "."),
            owner="SBC",
        )

    fresh = F.array_sort(F.array_except("codec_sets", "base_codec_sets"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(fresh, _python_list), ", "), F.lit("]"))
    codecs = finding(
        p.where(F.size(fresh) > 0), 203, "BASELINE_DIFF", "WARN", "Differs from baseline: codec set",
        words("Codec set(s) not seen in the baseline: ", listed, "."), owner="SBC",
    )
    added = p.where(F.size(F.array_except("media_directions", "base_media_directions")) > 0)
    dirs = finding(
        added, 204, "BASELINE_DIFF", "WARN", "Differs from baseline: media directions",
        words(
            "Baseline media directions = ", _python_list(F.col("base_media_directions")), "; this call = ",
            _python_list(F.col("media_directions")), ".",
        ),
        owner="SBC",
    )
    return (
        pair(200, "declared streams", "declared_streams", lambda c: c)
        .unionByName(pair(201, "observed streams", "observed_streams", lambda c: c))
        .unionByName(pair(202, "metadata present", "metadata_present", _python_bool))
        .unionByName(codecs)
        .unionByName(dirs)
    )
