"""Call-recording views over the driver tables, for queries and their SQL twins.

The driver tables hold no SIP, so ``events`` stands in: a user is a call, an
event is a packet or a message, and k (0-99, from ``props``) gives variety.
Thirty days are squeezed into 300 seconds. Both engines evaluate the same view
text; a few tokens differ by dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 8

_TOKENS = {
    "spark": {
        "#EVENTS#": "{events}",
        "#CUSTOMER#": "{customer}",
        "#MICROS#": "unix_micros(from_utc_timestamp(cast(ts as timestamp), current_timezone()))",
        "#HEX(": "concat('0x', lpad(lower(hex(",
        "#)HEX": ")), 8, '0'))",
    },
    "duckdb": {
        "#EVENTS#": "events",
        "#CUSTOMER#": "customer",
        "#MICROS#": "epoch_us(ts)",
        "#HEX(": "concat('0x', printf('%08x', ",
        "#)HEX": "))",
    },
}

_VIEWS: dict[str, str] = {
    # One row per event with the numbers the other views are made from.
    "ev": """
      select concat('call-', cast(user_id as string)) as call_id, user_id as c, event_id as frame_number,
             event_type, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
             cast(#MICROS# - 1704067200000000 as double) / cast(8640000000 as double) as t,
             cast(#MICROS# as double) / cast(1000000 as double) as ts_epoch
      from #EVENTS#""",
    # RTP and RTCP packets.
    "pk": """
      select call_id, 0 as file_idx, frame_number, ts_epoch,
             case when k = 19 then null else t end as t_rel,
             '10.1.0.1' as src_ip,
             cast(30000 + 4 * (c % 5000) + 2 * (k % 2) + case when event_type = 'purchase' then 1 else 0 end as int) as src_port,
             concat('10.2.0.', cast(c % 200 as string)) as dst_ip,
             cast(40000 + 4 * (c % 5000) + 2 * (k % 2)
                  + case when event_type = 'purchase' then case when c % 3 = 0 then 2 + 1 else 1 end else 0 end as int) as dst_port,
             case when event_type <> 'purchase' and k <> 13
                  then 4096 + 4 * c + case when k >= 90 then 1 else 0 end + 2 * (k % 2) end as ssrc,
             case when event_type <> 'purchase' and k <> 17 then cast((frame_number * 7) % 65536 as int) end as seq,
             case when event_type <> 'purchase' and c % 17 = 16 then 72 when event_type <> 'purchase'
                  then case k % 10 when 0 then 72 when 1 then 8 when 2 then 9 else 0 end end as p_type,
             case when event_type <> 'purchase' then ''
                  else case k % 5 when 0 then '200,202' when 2 then '203' when 4 then '200' else '201' end end as rtcp_pt,
             case when event_type <> 'purchase' or k % 7 = 6 or c % 13 = 12 then ''
                  when k % 3 = 0 then concat(#HEX(4096 + 4 * c + 2 * (k % 2)#)HEX, ',', #HEX(4097 + 4 * c + 2 * (k % 2)#)HEX)
                  else #HEX(4096 + 4 * c + 2 * (k % 2)#)HEX end as rtcp_ids,
             case when event_type <> 'purchase' or k % 5 in (2, 4) or c % 13 = 12 then ''
                  when k % 3 = 0 then concat(cast(cast(floor(k * 256 / 100) as bigint) as string), ',', cast(cast(floor(k / 2) as bigint) as string))
                  else cast(cast(floor(k * 256 / 100) as bigint) as string) end as rtcp_fraction,
             case when event_type <> 'purchase' or k % 5 in (2, 4) or c % 13 = 12 then ''
                  when k % 3 = 0 then concat(cast(k as string), ',', cast(k + 1 as string))
                  else cast(k as string) end as rtcp_cumulative,
             case when event_type <> 'purchase' or k % 5 in (2, 4) or c % 13 = 12 then ''
                  when k % 3 = 0 then concat(cast(8 * k as string), ',', cast(4 * k as string))
                  else cast(8 * k as string) end as rtcp_jitter
      from ev where event_type in ('view', 'click', 'purchase')""",
    # SIP messages with the scalars of their two media lines.
    "sip0": """
      select call_id, c, k, 0 as file_idx, frame_number, ts_epoch, case when k = 19 then null else t end as t_rel,
             case when k % 10 = 7 then '10.0.0.9' when k % 2 = 0 then '10.0.0.1' else '10.0.0.2' end as src_ip,
             5060 as src_port,
             case when k % 2 = 0 then '10.0.0.2' else '10.0.0.1' end as dst_ip,
             5060 as dst_port,
             case when c % 10 = 9 then 'SRS_TO_SRC' else 'UNKNOWN' end as direction,
             case when event_type = 'signup'
                  then case when k < 60 then 'INVITE' when k < 75 then 'UPDATE' when k < 85 then 'ACK'
                            when k < 95 then 'OPTIONS' else 'BYE' end end as method,
             case when event_type = 'error'
                  then case when k < 20 then 180 when k < 60 then 200 when k < 75 then 408 when k < 90 then 488 else 503 end end as status_code,
             case when event_type = 'error'
                  then case when k < 20 then 'Ringing' when k < 60 then 'OK' when k < 75 then 'Request Timeout'
                            when k < 90 then 'Not Acceptable Here' end end as reason_phrase,
             concat(cast(k % 5 + 1 as string), ' ',
                    case when event_type = 'error' then case when k % 2 = 0 then 'INVITE' else 'UPDATE' end
                         when k < 60 then 'INVITE' when k < 75 then 'UPDATE' when k < 85 then 'ACK'
                         when k < 95 then 'OPTIONS' else 'BYE' end) as cseq,
             concat('"A" <sip:u', cast(c as string), '@a.example>;tag=1') as from_header,
             concat('<SIP:rec', cast(k % 3 as string), '@b.example;x=1>') as to_header,
             case when k % 13 = 0 then null else concat('<sip:u', cast(c as string), '@10.9.', cast(k % 5 as string), '.1:5060>') end as contact,
             case when event_type = 'signup' and k >= 60 and k < 75 and k % 9 = 0 then 'application/rs-metadata' end as content_type,
             concat('X-K: ', cast(k as string)) as raw_headers,
             cast(null as string) as body,
             case when event_type = 'signup' and k % 2 = 0 then concat('ua-', cast(k % 3 as string)) end as user_agent,
             case when event_type = 'error' then case when k >= 20 then concat('srv-', cast(k % 4 as string)) else '' end end as server,
             concat('z9hG4bK', cast(k % 7 as string)) as via_branch,
             concat('10.0.0.', cast(k % 3 as string), ':5060') as via_sent_by,
             (event_type = 'signup' and k < 75 and k % 11 <> 10 and c % 29 <> 28) as has_sdp,
             (event_type = 'signup' and k < 60 and k % 5 = 0 and c % 3 <> 2) as has_metadata_body,
             cast(case when k % 12 = 7 then 0 else 30000 + 4 * (c % 5000) + case when k % 4 = 1 then 10000 else 0 end end as int) as port0,
             cast(30002 + 4 * (c % 5000) + case when k % 4 = 1 then 10000 else 0 end as int) as port1,
             case when k % 10 < 3 then 'inactive' when k % 10 < 9 then 'sendonly' else 'sendrecv' end as dir0,
             case when k % 10 = 5 then null when k % 10 < 3 then 'inactive' when k % 10 < 9 then 'sendonly' else 'sendrecv' end as dir1,
             case when c % 4 = 3 then null else '0' end as label0,
             case when c % 4 = 3 then null else '2' end as label1,
             case when k % 8 = 5 then 'video' else 'audio' end as type1,
             case when k % 2 = 0 then '0 8 101' when k % 16 = 15 and c % 4 = 2 then '9 101' else '8 101' end as pts,
             (k % 3 = 0) as mux,
             cast(case when k % 6 = 1 then 30005 + 4 * (c % 5000) end as int) as rtcp_port0
      from ev where event_type in ('signup', 'error')""",
    "sip": """
      select *, cast(row_number() over (partition by call_id order by coalesce(t_rel, cast(0 as double)), file_idx, frame_number) - 1 as bigint) as msg_idx,
             (has_metadata_body or coalesce(content_type, '') = 'application/rs-metadata') as has_metadata,
             case when has_sdp then concat('- 1 1 IN IP4 10.5.0.', cast(k % 6 as string)) end as sdp_origin
      from sip0""",
    # Media lines as rows.
    "media": """
      select call_id, msg_idx, 0 as media_idx, 'audio' as media_type, port0 as port, pts, dir0 as direction,
             label0 as label, 'm0' as mid, rtcp_port0 as rtcp_port, mux as rtcp_mux from sip where has_sdp
      union all
      select call_id, msg_idx, 1, type1, port1, pts, dir1, label1, 'm1', cast(null as int), mux from sip where has_sdp and c % 9 <> 8""",
    "snap": """
      select call_id, c, k, msg_idx, '1' as version,
             concat('<recording v="', cast(k % 2 as string), '"/>', case when k % 4 = 0 then ' ' else '' end) as raw_xml,
             case when k % 25 = 0 then 0 else 1 end as n_sessions,
             case when k % 25 = 0 or k % 25 = 5 then 0 else 2 end as n_participants,
             case when k % 25 = 0 then 0 else 2 end as n_streams
      from sip where has_metadata_body""",
    "rs0": "select *, 0 as ord from snap where n_streams = 2 union all select *, 1 as ord from snap where n_streams = 2",
    "rstr": """
      select call_id, msg_idx, ord, concat('S', cast(c as string), '-', cast(ord as string)) as stream_id,
             case when c % 5 = 4 then case when ord = 0 then '7' else '8' end
                  else case when ord = 0 then '0' else '2' end end as label,
             case when ord = 0 then concat('P', cast(c as string), 'a')
                  when k % 10 = 5 then null else concat('P', cast(c as string), 'b') end as pid
      from rs0""",
    "rspa": """
      select s.call_id, s.msg_idx, s.ord,
             concat('P', cast(s.c as string), case when s.ord = 0 then 'a' else 'b' end) as participant_id,
             case when s.ord = 0 then u.c_name end as name,
             case when s.ord = 0 then concat('sip:', cast(s.c as string), '@cc.example')
                  else concat('sip:agent', cast(s.c % 7 as string), '@cc.example') end as aor
      from rs0 s left join #CUSTOMER# u on u.c_custkey = s.c where s.n_participants = 2""",
}
_NEEDS = {
    "ev": [], "pk": ["ev"], "sip0": ["ev"], "sip": ["sip0"], "media": ["sip"], "snap": ["sip"],
    "rs0": ["snap"], "rstr": ["rs0"], "rspa": ["rs0"],
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def add(n: str) -> None:
        for d in _NEEDS[n]:
            add(d)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def cte(dialect: str, *names: str) -> str:
    """The named views and what they need, as common table expressions."""
    text = ",\n".join(f"{n} as ({_VIEWS[n]})" for n in _closure(names))
    for token, value in _TOKENS[dialect].items():
        text = text.replace(token, value)
    return text


class DriverViews:
    """The views as Spark tables in the library's schemas."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        args = {"events": self.table("events")}
        if name == "rspa":
            args["customer"] = self.table("customer")
        # Views grow with the tables: joined by sort-merge, not broadcast through the driver.
        return self.spark.sql(f"with {cte('spark', name)} select * from {name}", **args).hint("merge")

    def packets(self) -> DataFrame:
        """Packets that already carry their call."""
        return self.view("pk")

    def raw_packets(self) -> DataFrame:
        return self.view("pk").drop("call_id")

    def messages(self) -> DataFrame:
        def line(i: int):
            return F.struct(
                F.lit(i).alias("media_idx"),
                (F.lit("audio") if i == 0 else F.col("type1")).alias("media_type"),
                F.col(f"port{i}").alias("port"),
                F.lit("RTP/AVP").alias("protocol"),
                F.split("pts", " ").alias("payload_types"),
                F.lit(None).cast("string").alias("connection_address"),
                F.col(f"dir{i}").alias("direction"),
                F.col(f"label{i}").alias("label"),
                F.lit(f"m{i}").alias("mid"),
                (F.col("rtcp_port0") if i == 0 else F.lit(None).cast("int")).alias("rtcp_port"),
                F.col("mux").alias("rtcp_mux"),
            )

        extra = ["port0", "port1", "dir0", "dir1", "label0", "label1", "type1", "pts", "mux", "rtcp_port0", "c", "k"]
        return (
            self.view("sip")
            .withColumn(
                "media",
                F.when(F.col("has_sdp") & (F.col("c") % 9 == 8), F.array(line(0))).when(
                    F.col("has_sdp"), F.array(line(0), line(1))
                ),
            )
            .drop(*extra)
        )

    def unindexed_messages(self) -> DataFrame:
        return self.messages().drop("msg_idx")

    def snapshots(self) -> DataFrame:
        return self.view("snap").drop("c", "k")

    def rs_streams(self) -> DataFrame:
        ids = F.when(F.col("pid").isNotNull(), F.array("pid")).otherwise(F.array().cast("array<string>"))
        return self.view("rstr").withColumn("participant_ids", ids).drop("pid")

    def rs_participants(self) -> DataFrame:
        return self.view("rspa")
