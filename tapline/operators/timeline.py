"""Session timeline: phases, hold windows, hold/retrieve events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sdp as sdp_fn
from .messages import with_flags
from .ordering import CHUNK_ROWS, chunk_of, with_previous


def timeline_scalars(messages: DataFrame) -> DataFrame:
    """Per call: establishment (first 2xx to INVITE) and termination (last BYE)."""
    m = with_flags(messages)
    ok = F.col("is_response") & F.col("status_code").between(200, 299) & (F.col("cmethod") == "INVITE")
    bye = ~F.col("is_response") & (F.col("cmethod") == "BYE")
    return m.groupBy("call_id").agg(
        F.min(F.when(ok, F.col("msg_idx"))).alias("established_idx"),
        F.min_by("t_rel", F.when(ok, F.col("msg_idx"))).alias("established_at"),
        F.max_by("t_rel", F.when(bye, F.col("msg_idx"))).alias("terminated_at"),
    )


def _hold_states(messages: DataFrame, chunk_rows: int) -> DataFrame:
    """Offers that open (timed and inactive) or close (active) a hold, each with
    the state before it."""
    m = with_flags(messages).where("not is_response and cmethod in ('INVITE', 'UPDATE')")
    rows = (
        m.select("call_id", "msg_idx", "frame_number", "t_rel", sdp_fn.media_direction("media").alias("dir"))
        .withColumn(
            "state",
            F.when((F.col("dir") == "inactive") & F.col("t_rel").isNotNull(), "open").when(
                F.col("dir").isin(*sdp_fn.ACTIVE_DIRECTIONS), "close"
            ),
        )
        .where("state is not null")
        .withColumn("_chunk", chunk_of("msg_idx", chunk_rows))
    )
    return with_previous(rows, ["call_id"], "_chunk", "msg_idx", {"before": "state"})


def hold_windows(messages: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(call, open message, start, end); an unclosed hold ends with the session."""
    states = _hold_states(messages, chunk_rows)
    turns = states.where(
        "(state = 'open' and coalesce(before, 'close') = 'close') or (state = 'close' and before = 'open')"
    ).select("call_id", "msg_idx", "_chunk", "t_rel", "state")
    paired = with_previous(
        turns, ["call_id"], "_chunk", "msg_idx", {"open_idx": "msg_idx", "open_t": "t_rel"}
    )
    closed = paired.where("state = 'close'").select(
        "call_id", F.col("open_idx").alias("msg_idx"), F.col("open_t").alias("hold_start"),
        F.col("t_rel").alias("hold_end"),
    )
    last = turns.groupBy("call_id").agg(
        F.max_by(F.struct("state", "msg_idx", "t_rel"), "msg_idx").alias("x")
    )
    unclosed = (
        last.where("x.state = 'open'")
        .join(timeline_scalars(messages).select("call_id", "terminated_at"), "call_id", "left")
        .select("call_id", "x.msg_idx", F.col("x.t_rel").alias("hold_start"), F.col("terminated_at").alias("hold_end"))
    )
    return closed.unionByName(unclosed)


def timeline_events(messages: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Phase events of a session in message order."""
    scal = timeline_scalars(messages).select("call_id", "established_idx")
    resumed = (
        _hold_states(messages, chunk_rows)
        .where("state = 'close' and before = 'open'")
        .select("call_id", "msg_idx", F.lit(True).alias("resumed"))
    )
    m = (
        with_flags(messages)
        .withColumn("dir", sdp_fn.media_direction("media"))
        .join(scal, "call_id", "left")
        .join(resumed, ["call_id", "msg_idx"], "left")
    )
    req = ~F.col("is_response")
    offer = req & F.col("cmethod").isin("INVITE", "UPDATE")
    after = F.coalesce(F.col("msg_idx") > F.col("established_idx"), F.lit(False))

    def event(cond, kind, description):
        return F.when(
            cond,
            F.struct(
                (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"),
                (F.lit(description) if isinstance(description, str) else description).alias("description"),
            ),
        )

    invite = F.when(after, F.lit("reinvite")).otherwise(F.lit("invite"))
    invite_text = F.when(after, F.lit("re-INVITE")).otherwise(F.lit("Initial INVITE"))
    status_text = F.trim(F.concat_ws(" ", F.col("status_code").cast("string"), F.coalesce("reason_phrase", F.lit(""))))
    events = F.array(
        event(~req & F.col("status_code").between(100, 199), "provisional", status_text),
        event(F.col("msg_idx") == F.col("established_idx"), "established", "Session established (200 OK to INVITE)"),
        event(req & (F.col("cmethod") == "INVITE"), invite, invite_text),
        event(req & (F.col("cmethod") == "UPDATE"), "update", "UPDATE"),
        event(offer & F.col("has_metadata"), "metadata", "SIPREC metadata present"),
        event(offer & (F.col("dir") == "inactive"), "hold", "Media set inactive (hold)"),
        event(offer & F.col("resumed"), "resume", F.concat(F.lit("Media resumed ("), F.col("dir"), F.lit(")"))),
        event(req & (F.col("cmethod") == "ACK"), "ack", "ACK"),
        event(req & (F.col("cmethod") == "BYE"), "bye", "BYE"),
        event(req & (F.col("cmethod") == "BYE"), "terminated", "Session terminated"),
    )
    return m.select(
        "call_id", "msg_idx", "t_rel", "frame_number",
        F.posexplode(F.filter(events, lambda e: e.isNotNull())).alias("ev_no", "e"),
    ).select("call_id", "msg_idx", "ev_no", "t_rel", "frame_number", "e.event_type", "e.description")


def hold_retrieve_events(messages: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """HOLD at the first all-inactive offer, RETRIEVE at the first active one after it.

    The first INVITE of a call is the initial offer and never counts.
    """
    m = with_flags(messages).where("is_request and cmethod in ('INVITE', 'UPDATE')")
    first = m.groupBy("call_id").agg(
        F.min(F.when(F.col("cmethod") == "INVITE", F.col("msg_idx"))).alias("_first")
    )
    rows = (
        m.join(first, "call_id")
        .where("_first is null or msg_idx <> _first")
        .select(
            "call_id", "msg_idx", "t_rel", "frame_number", "cseq",
            F.when(sdp_fn.all_inactive("media"), "HOLD")
            .when(sdp_fn.any_active("media"), "RETRIEVE")
            .alias("kind"),
        )
        .where("kind is not null")
        .withColumn("_chunk", chunk_of("msg_idx", chunk_rows))
        .repartition("call_id", "_chunk")
    )
    out = with_previous(rows, ["call_id"], "_chunk", "msg_idx", {"before": "kind"})
    return out.where(
        "(kind = 'HOLD' and coalesce(before, 'RETRIEVE') = 'RETRIEVE')"
        " or (kind = 'RETRIEVE' and before = 'HOLD')"
    ).select("call_id", "msg_idx", "kind", "t_rel", "frame_number", "cseq")
