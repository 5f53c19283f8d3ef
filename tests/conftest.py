import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapline.session import local_session  # noqa: E402

MESSAGE = (
    "call_id string, msg_idx bigint, file_idx int, frame_number bigint, ts_epoch double, t_rel double, src_ip string, src_port int, "
    "dst_ip string, dst_port int, direction string, method string, status_code int, reason_phrase string, cseq string, "
    "from_header string, to_header string, contact string, content_type string, raw_headers string, body string, "
    "user_agent string, server string, via_branch string, via_sent_by string, has_sdp boolean, has_metadata_body boolean, "
    "has_metadata boolean, sdp_origin string, media array<struct<media_idx:int,media_type:string,port:int,protocol:string,"
    "payload_types:array<string>,connection_address:string,direction:string,label:string,mid:string,rtcp_port:int,rtcp_mux:boolean>>"
)
PACKET = (
    "call_id string, file_idx int, frame_number bigint, ts_epoch double, t_rel double, src_ip string, src_port int, dst_ip string, "
    "dst_port int, ssrc bigint, seq int, p_type int, rtcp_pt string, rtcp_ids string, rtcp_fraction string, "
    "rtcp_cumulative string, rtcp_jitter string"
)
MEDIA = (
    "call_id string, msg_idx bigint, media_idx int, media_type string, port int, label string, mid string, direction string, "
    "rtcp_port int, rtcp_mux boolean"
)
RS_STREAM = "call_id string, msg_idx bigint, ord int, stream_id string, session_id string, media_type string, label string, participant_ids array<string>"
RS_PARTICIPANT = "call_id string, msg_idx bigint, ord int, participant_id string, name string, aor string"
SNAPSHOT = "call_id string, msg_idx bigint, version string, raw_xml string, n_sessions int, n_participants int, n_streams int"
STREAM = (
    "call_id string, stream_idx bigint, ssrc bigint, src_ip string, src_port int, dst_ip string, dst_port int, payload_type int, "
    "packet_count bigint, first_t double, last_t double, sequence_gaps bigint, largest_gap bigint, rtcp_observed boolean, "
    "matched_sdp_label string, matched_siprec_stream_id string, participant_aor string, participant_name string"
)


def names(schema: str) -> list[str]:
    depth, out, word = 0, [], ""
    for ch in schema + ",":
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            out.append(word.split()[0])
            word = ""
        else:
            word += ch
    return out


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tapline-tests", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def table(spark):
    """Rows given as dicts, missing columns null."""

    def build(schema: str, rows: list[dict], **defaults):
        cols = names(schema)
        return spark.createDataFrame([tuple({**defaults, **r}.get(c) for c in cols) for r in rows], schema)

    return build


def media(direction="sendonly", port=30000, label=None, payloads=("0",), kind="audio", idx=0, mid=None):
    return (idx, kind, port, "RTP/AVP", list(payloads), None, direction, label, mid, None, False)


@pytest.fixture
def messages(table):
    """Messages from (method-or-status, t, extras) in order, one call unless told otherwise."""

    def build(specs: list[dict]):
        rows = []
        counters: dict[str, int] = {}
        for s in specs:
            s = dict(s)
            call = s.setdefault("call_id", "c1")
            i = counters.get(call, 0)
            counters[call] = i + 1
            what = s.pop("what")
            base = {
                "msg_idx": i, "file_idx": 0, "frame_number": i + 1, "t_rel": s.get("t_rel", 0.0), "ts_epoch": 1700000000.0 + (s.get("t_rel") or 0.0),
                "src_ip": "10.0.0.1", "src_port": 5060, "dst_ip": "10.0.0.2", "dst_port": 5060, "direction": "UNKNOWN",
                "from_header": "<sip:src@a>", "to_header": "<sip:dst@b>", "raw_headers": "", "has_metadata_body": False, "has_metadata": False,
            }
            if isinstance(what, int):
                base |= {"status_code": what, "reason_phrase": "OK", "cseq": "1 INVITE"}
            else:
                base |= {"method": what, "cseq": f"1 {what}"}
            base |= s
            base["has_sdp"] = base.get("media") is not None
            rows.append(base)
        return table(MESSAGE, rows)

    return build
