"""SIP transactions: re-INVITEs, bursts, retransmissions, refresh timers, delays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sdp as sdp_fn
from ..session import parquet_stage
from .jumps import visited
from .messages import with_flags
from .ordering import CHUNK_ROWS, as_of_last, chunk_of, dense_index, with_previous
from .timeline import timeline_scalars

# Fixed values.
BURST_MIN_COUNT = 3
BURST_WINDOW_S = 5.0
SLOW_ANSWER_S = 6.0
TIMER_MIN_INTERVAL_S = 30
TIMER_TOLERANCE = 0.2


def reinvites(messages: DataFrame) -> DataFrame:
    """Offers inside a dialog: every UPDATE, and INVITE requests after the first."""
    m = with_flags(messages).where("is_request and cmethod in ('INVITE', 'UPDATE')")
    first = m.groupBy("call_id").agg(
        F.min(F.when(F.col("cmethod") == "INVITE", F.col("msg_idx"))).alias("_first")
    )
    return (
        m.join(first, "call_id")
        .where("cmethod = 'UPDATE' or msg_idx > _first")
        .drop("_first")
    )


def burst_members(
    messages: DataFrame,
    min_count: int = BURST_MIN_COUNT,
    window_s: float = BURST_WINDOW_S,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Messages of each burst with the burst's first message index.

    In time order, the oldest candidate not decided yet begins a burst with all candidates up to
    ``window_s`` later if these are ``min_count`` or more, and else none. So every candidate
    jumps to the next one, or behind its burst; bursts begin where the walk over these jumps
    passes (``jumps.visited``), which any number of tasks can follow.
    """
    keep = parquet_stage(messages.sparkSession)
    cand = reinvites(messages).where("t_rel is not null").select(
        "call_id", "msg_idx", "t_rel", "frame_number", "cmethod", sdp_fn.offered_payloads("media").alias("payloads"),
    )
    cand = keep("burst_candidates", dense_index(cand.withColumn("_chunk", chunk_of("msg_idx", chunk_rows)), ["call_id"], "_chunk", ["msg_idx"], "i").drop("_chunk"))
    times = cand.select("call_id", "i", "t_rel")
    # The last candidate in reach of each one.
    reach = as_of_last(times, times, ["call_id"], "t_rel", "t_rel", ["i"], {"last": "i"}, tolerance=window_s, bucket_seconds=max(window_s, 1.0))
    begins = F.col("last") - F.col("i") + 1 >= min_count
    jumps = keep("burst_jumps", reach.select("call_id", "i", "last", begins.alias("begins"), F.when(begins, F.col("last") + 1).otherwise(F.col("i") + 1).alias("to")))
    firsts = jumps.where("begins").select("call_id", "i", "last").join(visited(jumps, keep, chunk_rows), ["call_id", "i"])
    firsts = firsts.join(cand.select("call_id", "i", F.col("msg_idx").alias("burst_idx")), ["call_id", "i"])
    firsts = keep("burst_firsts", firsts.select("call_id", F.col("i").alias("first"), "last", "burst_idx"))
    found = as_of_last(cand, firsts, ["call_id"], "i", "first", [], {"burst_idx": "burst_idx", "last": "last"}, bucket_seconds=float(chunk_rows))
    return found.where("i <= last").select("call_id", "msg_idx", "burst_idx", "t_rel", "frame_number", "cmethod", "payloads")


def bursts(members: DataFrame) -> DataFrame:
    """One row per burst; several distinct offers mean codec renegotiation."""
    offers = F.when(F.size("payloads") > 0, F.array_join("payloads", " "))
    return members.groupBy("call_id", "burst_idx").agg(
        F.min("t_rel").alias("window_start"),
        F.max("t_rel").alias("window_end"),
        F.count(F.lit(1)).alias("count"),
        (F.min(offers) != F.max(offers)).alias("_reneg"),
    ).select(
        "call_id", "burst_idx", "window_start", "window_end", "count",
        F.coalesce("_reneg", F.lit(False)).alias("codec_renegotiation"),
    )


def _transaction_key(messages: DataFrame) -> DataFrame:
    m = with_flags(messages)
    none = F.lit("\u0000")
    return m.withColumn("kind", F.when(F.col("is_response"), "R").otherwise("Q")).withColumn(
        "what",
        F.when(F.col("is_response"), F.col("status_code").cast("string")).otherwise(F.col("method")),
    ).withColumn(
        "_tx",
        F.concat_ws(
            "\u0001", "kind", F.coalesce("what", none), F.coalesce("cseq", none), F.coalesce("via_branch", none)
        ),
    )


def retransmission_groups(messages: DataFrame) -> DataFrame:
    """Transactions seen more than once: same kind, method or status, CSeq, branch."""
    return (
        _transaction_key(messages)
        .groupBy("call_id", "_tx")
        .agg(
            F.first("kind").alias("kind"),
            F.first("what").alias("what"),
            F.first("cseq").alias("cseq"),
            F.first("via_branch").alias("via_branch"),
            F.count(F.lit(1)).alias("n"),
            F.min("msg_idx").alias("first_idx"),
        )
        .where("n > 1")
    )


def flag_retransmissions(messages: DataFrame) -> DataFrame:
    """Every message with ``is_retransmission``: a later member of its transaction."""
    keyed = _transaction_key(messages)
    groups = retransmission_groups(messages).select("call_id", "_tx", "first_idx")
    return keyed.join(groups, ["call_id", "_tx"], "left").select(
        *messages.columns,
        F.coalesce(F.col("msg_idx") > F.col("first_idx"), F.lit(False)).alias("is_retransmission"),
        "first_idx",
    )


def refresh_intervals(messages: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Pauses between offers of a call, the first offer left out."""
    m = with_flags(messages).where(
        "is_request and cmethod in ('INVITE', 'UPDATE') and t_rel is not null"
    )
    first = m.groupBy("call_id").agg(F.min("msg_idx").alias("_first"))
    rows = (
        m.join(first, "call_id")
        .where("msg_idx > _first")
        .select("call_id", "msg_idx", "t_rel")
        .withColumn("_chunk", chunk_of("msg_idx", chunk_rows))
        .repartition("call_id", "_chunk")
    )
    out = with_previous(rows, ["call_id"], "_chunk", "msg_idx", {"_pt": "t_rel"})
    return out.where("_pt is not null").select(
        "call_id", "msg_idx", (F.col("t_rel") - F.col("_pt")).alias("interval_s")
    )


def session_timers(messages: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Calls whose refresh offers come at a regular, non-trivial period."""
    per_call = refresh_intervals(messages, chunk_rows).groupBy("call_id").agg(
        F.avg("interval_s").alias("avg_s"),
        F.min("interval_s").alias("min_s"),
        F.max("interval_s").alias("max_s"),
        F.count(F.lit(1)).alias("n_intervals"),
    )
    slack = F.lit(TIMER_TOLERANCE) * F.col("avg_s")
    regular = (F.col("max_s") - F.col("avg_s") <= slack) & (F.col("avg_s") - F.col("min_s") <= slack)
    return per_call.withColumn("is_refresh", (F.col("avg_s") > TIMER_MIN_INTERVAL_S) & regular)


def post_dial_delay(messages: DataFrame) -> DataFrame:
    """Seconds from the first timed INVITE to the answer."""
    asked = messages.where("method = 'INVITE' and t_rel is not null").groupBy("call_id").agg(
        F.min_by("t_rel", "msg_idx").alias("invite_t")
    )
    return (
        timeline_scalars(messages)
        .where("established_at is not null")
        .join(asked, "call_id")
        .select("call_id", (F.col("established_at") - F.col("invite_t")).alias("pdd_s"))
    )


def calls_missing_ack(messages: DataFrame) -> DataFrame:
    """Established calls without any ACK request."""
    acks = with_flags(messages).where("is_request and cmethod = 'ACK'").select("call_id").distinct()
    return (
        timeline_scalars(messages)
        .where("established_at is not null")
        .join(acks, "call_id", "left_anti")
        .select("call_id", "established_at")
    )
