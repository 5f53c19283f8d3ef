"""Physical plans that must hold at scale."""

import re

from conftest import PACKET
from tapline.operators import messages as msg
from tapline.operators import scope, ssrc, streams, timeline
from tapline.session import parquet_stage


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().explainString(mode))


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_streams_shuffle_packets_once_on_key_and_chunk(table, tmp_path):
    p = stored(table(PACKET, [dict(call_id="c", file_idx=0, frame_number=1, rtcp_pt="")]), tmp_path / "p")
    plan = plan_of(streams.rtp_streams(p))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "hashpartitioning(call_id, _ssrc, _dip, _dport, _chunk" in plan
    scan = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert "rtcp_jitter" not in scan and "ts_epoch" not in scan


def test_ssrc_changes_summaries_combine_before_the_shuffle(table, tmp_path):
    p = stored(table(PACKET, [dict(call_id="c", file_idx=0, frame_number=1, rtcp_pt="")]), tmp_path / "p")
    plan = plan_of(ssrc.ssrc_changes(ssrc.ssrc_observations(p)))
    assert "partial_max_by" in plan and "IsNotNull(ssrc)" in plan


def test_no_nested_loop_or_cartesian_join(spark, table, messages, tmp_path):
    p = stored(table(PACKET, [dict(call_id="c", file_idx=0, frame_number=1, rtcp_pt="")]).drop("call_id"), tmp_path / "p")
    m = stored(messages([dict(what="INVITE")]), tmp_path / "m")
    ports = scope.call_ports(msg.sdp_media(m))
    plan = plan_of(scope.scope_media_to_calls(p, ports, msg.call_span(m), scope.calls_without_ports(m, ports)))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_message_windows_never_cover_a_whole_call(spark, messages, tmp_path):
    m = stored(messages([dict(what="INVITE")]), tmp_path / "m")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(timeline.hold_retrieve_events(m))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    row_window = plan[plan.index("lag(_cur"):]
    assert re.search(r"Exchange hashpartitioning\(call_id, _chunk, \d+\), REPARTITION_BY_COL", row_window)


def test_stages_and_summary_rows_are_not_broadcast(spark, messages):
    m = parquet_stage(spark)("m", messages([dict(what="INVITE")]))
    calls = m.groupBy("call_id").agg({"msg_idx": "max"})
    plan = plan_of(m.select("call_id", "t_rel").join(calls, "call_id"))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    plan = plan_of(timeline.hold_retrieve_events(messages([dict(what="INVITE")])))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
