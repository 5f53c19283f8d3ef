"""SQL twins of the operators over the driver views, in DuckDB's dialect.

Each block states what an operator computes as plain SQL over the views; blocks
build on each other by name. Detector blocks share one column layout so that
their union feeds the health, batch and report blocks.
"""

from __future__ import annotations

from .driver_views import _NEEDS as VIEW_NEEDS
from .driver_views import cte

MIN_PACKETS = 3
BURST_WINDOW_S = 20.0

_B: dict[str, tuple[list[str], str]] = {}


def _block(name: str, needs: list[str], sql: str) -> None:
    _B[name] = (needs, sql)


# --- streams -----------------------------------------------------------------

_block("mr", ["pk"], "select * from pk where rtcp_pt = '' and not coalesce(p_type between 64 and 95, false)")
_block("steps", ["mr"], """
  select * from (
    select call_id, ssrc, dst_ip, dst_port, file_idx, frame_number, seq,
           (seq - lag(seq) over (partition by call_id, ssrc, dst_ip, dst_port order by frame_number) + 65536) % 65536 as delta
    from mr where seq is not null) where delta is not null""")
_block("st", ["mr", "steps"], f"""
  select a.*, row_number() over (partition by a.call_id order by first_ord) - 1 as stream_idx,
         coalesce(g.gaps, 0) as sequence_gaps, coalesce(g.worst, 0) as largest_gap
  from (
    select call_id, ssrc, dst_ip, dst_port, count(*) as packet_count, min(frame_number) as first_ord,
           arg_min(src_ip, frame_number) as src_ip, arg_min(src_port, frame_number) as src_port,
           arg_min(p_type, frame_number) as payload_type,
           arg_min(t_rel, frame_number) filter (t_rel is not null) as first_t,
           arg_max(t_rel, frame_number) filter (t_rel is not null) as last_t,
           arg_min(seq, frame_number) filter (seq is not null) as first_seq,
           arg_max(seq, frame_number) filter (seq is not null) as last_seq
    from mr group by call_id, ssrc, dst_ip, dst_port) a
  left join (
    select call_id, ssrc, dst_ip, dst_port, count(*) filter (delta > 1) as gaps,
           max(delta - 1) filter (delta > 1) as worst from steps group by all) g
  on a.call_id = g.call_id and a.ssrc is not distinct from g.ssrc and a.dst_ip = g.dst_ip and a.dst_port = g.dst_port""")
_block("targets", ["pk"], """
  select distinct call_id, dst_ip, dst_port from pk where rtcp_pt <> '' or coalesce(p_type between 64 and 95, false)""")
_block("sto", ["st", "targets"], """
  select s.*, exists (select 1 from targets t where t.call_id = s.call_id and t.dst_ip = s.dst_ip
                      and t.dst_port in (s.dst_port, s.dst_port + 1)) as rtcp_observed from st s""")
_block("muxn", ["pk"], """
  select call_id, count(*) filter (rtcp_pt <> '' or coalesce(p_type between 64 and 95, false)) as rtcp_on_media_ports
  from pk group by call_id""")
_block("obs", ["pk"], """
  select call_id, frame_number as ord,
         concat(src_ip, ':', src_port, '->', dst_ip, ':', dst_port) as flow_key, t_rel, ssrc
  from pk where rtcp_pt = '' and ssrc is not null""")
_block("chg", ["obs"], """
  select call_id, flow_key, ord, t_rel, from_ssrc, ssrc as to_ssrc from (
    select *, lag(ssrc) over (partition by call_id, flow_key order by ord) as from_ssrc from obs)
  where from_ssrc <> ssrc""")
_block("trans", ["chg", "st"], f"""
  select call_id,
         cast(count(*) filter (real) as bigint) as real_changes, cast(count(*) filter (not real) as bigint) as noise_changes
  from (
    select c.call_id,
           exists (select 1 from st s where s.call_id = c.call_id and s.packet_count >= {MIN_PACKETS}
                   and s.ssrc in (c.from_ssrc, c.to_ssrc))
           or not exists (select 1 from st s where s.call_id = c.call_id) as real
    from chg c) group by call_id""")

# --- RTCP and quality ---------------------------------------------------------

_block("rr", ["pk"], "select * from pk where rtcp_pt <> '' or coalesce(p_type between 64 and 95, false)")
_block("blk", ["rr"], """
  select call_id, file_idx, frame_number, cast(i - 1 as int) as block, t_rel,
         try_cast(case when ids[i] like '0x%' then ids[i] end as bigint) as ssrc,
         try_cast(fr[i] as bigint) as fraction, try_cast(cu[i] as bigint) as cumulative, try_cast(ji[i] as bigint) as jitter
  from (
    select *, unnest(range(1, greatest(len(ids), len(fr), len(cu), len(ji)) + 1)) as i from (
      select *, case when rtcp_ids = '' then [] else string_split(rtcp_ids, ',') end as ids,
             case when rtcp_fraction = '' then [] else string_split(rtcp_fraction, ',') end as fr,
             case when rtcp_cumulative = '' then [] else string_split(rtcp_cumulative, ',') end as cu,
             case when rtcp_jitter = '' then [] else string_split(rtcp_jitter, ',') end as ji
      from rr))""")
_block("pts", ["rr"], """
  select call_id, frame_number, muxed, unnest(list) as pt from (
    select *, rtcp_pt = '' as muxed,
           case when rtcp_pt = '' then [cast(p_type + 128 as varchar)] else string_split(rtcp_pt, ',') end as list from rr)""")
_block("rsum", ["rr", "pts", "blk"], """
  select r.call_id, r.total, r.muxed_as_rtp, p.sr, p.rr, p.sdes, p.bye, p.app, p.other, coalesce(b.n, 0) as report_blocks
  from (select call_id, count(*) as total, count(*) filter (rtcp_pt = '') as muxed_as_rtp from rr group by all) r
  join (select call_id, count(*) filter (pt = '200') as sr, count(*) filter (pt = '201') as rr, count(*) filter (pt = '202') as sdes,
               count(*) filter (pt = '203') as bye, count(*) filter (pt = '204') as app,
               count(*) filter (pt not in ('200', '201', '202', '203', '204')) as other from pts group by all) p using (call_id)
  left join (select call_id, count(*) as n from blk b where (ssrc is not null or fraction is not null or jitter is not null)
             and exists (select 1 from rr x where x.frame_number = b.frame_number and (x.rtcp_fraction <> '' or x.rtcp_jitter <> ''))
             group by all) b using (call_id)""")
_block("byes", ["rr"], """
  select distinct call_id, case when id = '' then null else cast(id as bigint) end as ssrc from (
    select call_id, unnest(case when rtcp_ids = '' then [''] else string_split(rtcp_ids, ',') end) as id
    from rr where list_contains(string_split(rtcp_pt, ','), '203'))""")
_block("rgap", ["blk"], """
  select call_id, ssrc, max(g) as max_gap from (
    select call_id, ssrc, t_rel - lag(t_rel) over (partition by call_id, ssrc order by t_rel) as g from blk
    where t_rel is not null and (ssrc is not null or fraction is not null or jitter is not null))
  where g is not null group by all""")
_block("rst", ["blk", "rgap", "byes"], """
  select b.call_id, b.ssrc, b.report_count, b.fraction_lost_max, b.cumulative_lost, b.jitter_min, b.jitter_avg, b.jitter_max,
         g.max_gap as max_report_gap_s, y.call_id is not null as rtcp_bye_seen
  from (select call_id, ssrc, count(*) as report_count, max(fraction) / cast(256 as double) as fraction_lost_max,
               arg_max(cumulative, frame_number * 100 + block) filter (cumulative is not null) as cumulative_lost,
               cast(min(jitter) as double) as jitter_min, avg(jitter) as jitter_avg, cast(max(jitter) as double) as jitter_max
        from blk where ssrc is not null or fraction is not null or jitter is not null group by all) b
  left join rgap g on g.call_id = b.call_id and g.ssrc is not distinct from b.ssrc
  left join byes y on y.call_id = b.call_id and y.ssrc is not distinct from b.ssrc""")
_block("smp", ["blk", "bound"], """
  select call_id, ssrc, file_idx, frame_number, block, t_rel, codec, label, participant,
         case when r <= 0 then 1.0::double when r >= 100 then 4.5::double
              else greatest(1.0::double, least(4.5::double, cast(printf('%.2f', 1.0::double + 0.035::double * r
                   + 7e-6::double * r * (r - 60.0::double) * (100.0::double - r)) as double))) end as mos,
         cast(printf('%.1f', r) as double) as r_factor, cast(printf('%.2f', loss) as double) as loss_pct, cast(printf('%.2f', jit) as double) as jitter_ms
  from (
    select *, 93.2::double - (0.024::double * delay + case when delay > 177.3 then 0.11::double * (delay - 177.3::double) else 0::double end)
              - (ie + (95.0::double - ie) * (loss / (loss + bpl))) as r from (
      select *, 30.0::double + 2.0::double * jit as delay from (
        select b.*, coalesce(fraction, 0) / 256.0::double * 100.0::double as loss,
               coalesce(jitter, 0) * 1000.0::double / case when pt = 9 then 16000 else 8000 end as jit,
               case pt when 0 then 'PCMU (G.711u)' when 8 then 'PCMA (G.711a)' when 9 then 'G.722' else 'dynamic' end as codec,
               case when pt = 9 then 13.0::double else 0.0::double end as ie,
               case when pt = 9 then 18.0::double else 25.1::double end as bpl, w.label, w.participant
        from blk b left join (
          select call_id, ssrc, arg_min(payload_type, stream_idx) as pt,
                 arg_min(struct_pack(a := matched_sdp_label), stream_idx).a as label,
                 arg_min(struct_pack(a := coalesce(nullif(participant_name, ''), participant_aor)), stream_idx).a as participant
          from bound group by all) w
        on w.call_id = b.call_id and w.ssrc is not distinct from b.ssrc
        where fraction is not null or jitter is not null)))""")
_block("est", ["smp"], """
  select call_id, ssrc, codec, label, participant, count(*) as n_samples,
         cast(printf('%.2f', sum(cast(round(mos * 100) as bigint)) / (count(*) * 100)) as double) as mos_avg, min(mos) as mos_min,
         cast(printf('%.1f', sum(cast(round(r_factor * 100) as bigint)) / (count(*) * 100)) as double) as r_factor_avg,
         cast(printf('%.2f', sum(cast(round(loss_pct * 100) as bigint)) / (count(*) * 100)) as double) as loss_pct_avg,
         cast(printf('%.2f', sum(cast(round(jitter_ms * 100) as bigint)) / (count(*) * 100)) as double) as jitter_ms_avg,
         30.0::double as one_way_delay_ms
  from smp group by call_id, ssrc, codec, label, participant""")

# --- signalling ---------------------------------------------------------------

_block("sf", ["sip"], """
  select *, status_code is null as is_request, status_code is not null as is_response,
         coalesce(method, split_part(cseq, ' ', 2)) as cm from sip""")
_block("md", ["media"], """
  select call_id, msg_idx, bool_and(direction = 'inactive') as all_inactive,
         bool_or(direction in ('sendonly', 'sendrecv', 'recvonly')) as any_active,
         case when bool_and(direction = 'inactive') then 'inactive'
              else arg_min(direction, media_idx) filter (direction in ('sendonly', 'sendrecv', 'recvonly')) end as dir,
         string_agg(pts, ' ' order by media_idx) as offer
  from media group by call_id, msg_idx""")
_block("tl", ["sf"], """
  select call_id,
         min(msg_idx) filter (status_code between 200 and 299 and cm = 'INVITE') as established_idx,
         arg_min(struct_pack(t := t_rel), msg_idx) filter (status_code between 200 and 299 and cm = 'INVITE').t as established_at,
         arg_max(struct_pack(t := t_rel), msg_idx) filter (is_request and cm = 'BYE').t as terminated_at
  from sf group by call_id""")
_block("turns", ["sf", "md"], """
  select * from (
    select *, lag(st) over (partition by call_id order by msg_idx) as prev from (
      select s.call_id, s.msg_idx, s.t_rel, m.dir,
             case when m.dir = 'inactive' and s.t_rel is not null then 'open' when m.dir <> 'inactive' then 'close' end as st
      from sf s join md m using (call_id, msg_idx) where s.is_request and s.cm in ('INVITE', 'UPDATE'))
    where st is not null)
  where (st = 'open' and coalesce(prev, 'close') = 'close') or (st = 'close' and prev = 'open')""")
_block("hw", ["turns", "tl"], """
  select x.call_id, x.msg_idx, x.t_rel as hold_start, case when x.ns is null then tl.terminated_at else x.nt end as hold_end
  from (select *, lead(t_rel) over (partition by call_id order by msg_idx) as nt,
               lead(st) over (partition by call_id order by msg_idx) as ns from turns) x
  join tl using (call_id) where x.st = 'open'""")
_block("tev", ["sf", "md", "tl", "turns"], """
  select call_id, msg_idx, cast(row_number() over (partition by call_id, msg_idx order by place) - 1 as int) as ev_no,
         t_rel, frame_number, event_type, description from (
    select *, unnest([
        case when status_code between 100 and 199 then struct_pack(place := 1, event_type := 'provisional', description := concat(status_code, ' ', reason_phrase)) end,
        case when msg_idx = established_idx then struct_pack(place := 2, event_type := 'established', description := 'Session established (200 OK to INVITE)') end,
        case when is_request and cm = 'INVITE' then struct_pack(place := 3, event_type := case when msg_idx > established_idx then 'reinvite' else 'invite' end,
             description := case when msg_idx > established_idx then 're-INVITE' else 'Initial INVITE' end) end,
        case when is_request and cm = 'UPDATE' then struct_pack(place := 4, event_type := 'update', description := 'UPDATE') end,
        case when is_request and cm in ('INVITE', 'UPDATE') and has_metadata then struct_pack(place := 5, event_type := 'metadata', description := 'SIPREC metadata present') end,
        case when is_request and cm in ('INVITE', 'UPDATE') and dir = 'inactive' then struct_pack(place := 6, event_type := 'hold', description := 'Media set inactive (hold)') end,
        case when resumed then struct_pack(place := 7, event_type := 'resume', description := concat('Media resumed (', dir, ')')) end,
        case when is_request and cm = 'ACK' then struct_pack(place := 8, event_type := 'ack', description := 'ACK') end,
        case when is_request and cm = 'BYE' then struct_pack(place := 9, event_type := 'bye', description := 'BYE') end,
        case when is_request and cm = 'BYE' then struct_pack(place := 10, event_type := 'terminated', description := 'Session terminated') end
      ], recursive := true) from (
      select s.*, m.dir, tl.established_idx, t.call_id is not null as resumed
      from sf s join tl using (call_id) left join md m on m.call_id = s.call_id and m.msg_idx = s.msg_idx
      left join turns t on t.call_id = s.call_id and t.msg_idx = s.msg_idx and t.st = 'close'))
  where place is not null""")
_block("hre", ["sf", "md"], """
  select call_id, msg_idx, kind, t_rel, frame_number, cseq from (
    select *, lag(kind) over (partition by call_id order by msg_idx) as prev from (
      select s.call_id, s.msg_idx, s.t_rel, s.frame_number, s.cseq,
             case when m.all_inactive then 'HOLD' when m.any_active then 'RETRIEVE' end as kind
      from sf s join md m using (call_id, msg_idx)
      left join (select call_id, min(msg_idx) as fi from sf where is_request and cm = 'INVITE' group by all) f using (call_id)
      where s.is_request and s.cm in ('INVITE', 'UPDATE') and (f.fi is null or s.msg_idx <> f.fi))
    where kind is not null)
  where (kind = 'HOLD' and coalesce(prev, 'RETRIEVE') = 'RETRIEVE') or (kind = 'RETRIEVE' and prev = 'HOLD')""")
_block("rei", ["sf"], """
  select s.* from sf s left join (select call_id, min(msg_idx) as fi from sf where is_request and cm = 'INVITE' group by all) f using (call_id)
  where s.is_request and (s.cm = 'UPDATE' or (s.cm = 'INVITE' and s.msg_idx > f.fi))""")
_block("cand", ["rei"], f"""
  select *, row_number() over (partition by call_id order by t_rel, msg_idx) as i,
         count(*) over (partition by call_id order by t_rel range between current row and {BURST_WINDOW_S}::double following) as n
  from rei where t_rel is not null""")
_block("walk", ["cand"], """
  select call_id, 1::bigint as i from cand where i = 1
  union all
  select w.call_id, (w.i + case when c.n >= 3 then c.n else 1 end)::bigint from walk w
  join cand c on c.call_id = w.call_id and c.i = w.i
  where exists (select 1 from cand d where d.call_id = w.call_id and d.i = w.i + case when c.n >= 3 then c.n else 1 end)""")
_block("bm", ["walk", "cand", "md"], """
  select a.call_id, a.msg_idx as burst_idx, b.msg_idx, b.t_rel, b.frame_number, b.cm as cmethod, coalesce(m.offer, '') as offer
  from walk w join cand a on a.call_id = w.call_id and a.i = w.i and a.n >= 3
  join cand b on b.call_id = a.call_id and b.i >= a.i and b.i < a.i + a.n
  left join md m on m.call_id = b.call_id and m.msg_idx = b.msg_idx""")
_block("bu", ["bm"], """
  select call_id, burst_idx, min(t_rel) as window_start, max(t_rel) as window_end, count(*) as "count",
         count(distinct nullif(offer, '')) > 1 as codec_renegotiation,
         list(frame_number order by msg_idx) as frames from bm group by call_id, burst_idx""")
_block("rx", ["sf"], """
  select call_id, case when is_response then 'R' else 'Q' end as kind,
         case when is_response then cast(status_code as varchar) else method end as what, cseq, via_branch,
         count(*) as n, min(msg_idx) as first_idx, list(frame_number order by msg_idx) as frames
  from sf group by all having count(*) > 1""")
_block("iv", ["sf"], """
  select * from (
    select call_id, msg_idx, t_rel - lag(t_rel) over (partition by call_id order by msg_idx) as interval_s from (
      select *, row_number() over (partition by call_id order by msg_idx) as rn from sf
      where is_request and cm in ('INVITE', 'UPDATE') and t_rel is not null) where rn > 1)
  where interval_s is not null""")
_block("timer", ["iv"], """
  select *, avg_s > 30 and max_s - avg_s <= 0.2::double * avg_s and avg_s - min_s <= 0.2::double * avg_s as is_refresh from (
    select call_id, avg(interval_s) as avg_s, min(interval_s) as min_s, max(interval_s) as max_s, count(*) as n_intervals from iv group by all)""")
_block("pdd", ["sf", "tl"], """
  select tl.call_id, tl.established_at - f.t as pdd_s from tl
  join (select call_id, arg_min(t_rel, msg_idx) as t from sf where method = 'INVITE' and t_rel is not null group by all) f using (call_id)
  where tl.established_at is not null""")
_block("noack", ["sf", "tl"], """
  select call_id, established_at from tl where established_at is not null
  and call_id not in (select call_id from sf where is_request and cm = 'ACK')""")
_block("ends", ["sip"], """
  select c.call_id, case when i.direction = 'SRS_TO_SRC' then i.dst_ip else i.src_ip end as src_ip,
         case when i.direction = 'SRS_TO_SRC' then i.dst_port else i.src_port end as src_port,
         case when i.direction = 'SRS_TO_SRC' then i.src_ip else i.dst_ip end as srs_ip,
         case when i.direction = 'SRS_TO_SRC' then i.src_port else i.dst_port end as srs_port
  from (select distinct call_id from sip) c
  left join (select * from sip where method = 'INVITE' qualify row_number() over (partition by call_id order by msg_idx) = 1) i using (call_id)""")
_block("span", ["sip"], """
  select call_id, min(ts_epoch) as start_epoch, max(ts_epoch) as end_epoch, count(ts_epoch) as n_epochs, count(*) as n_messages
  from sip group by call_id""")

# --- binding -------------------------------------------------------------------

_block("pl", ["media"], """
  select call_id, port, arg_max(label, msg_idx * 10 + media_idx) as label from media
  where port <> 0 and label is not null group by all""")
_block("plm", ["media"], """
  select call_id, port, arg_max(coalesce(label, mid), msg_idx * 10 + media_idx) as label from media
  where port <> 0 and coalesce(label, mid) is not null group by all""")
_block("ls", ["rstr"], "select call_id, label, arg_max(stream_id, msg_idx * 10 + ord) as stream_id from rstr group by all")
_block("sp", ["rstr", "rspa"], """
  select i.call_id, i.stream_id, i.pid as participant_id, p.name as participant_name, p.aor as participant_aor
  from (select call_id, stream_id, arg_max(pid, msg_idx * 10 + ord) as pid from rstr where pid is not null group by all) i
  join (select call_id, participant_id, arg_max(struct_pack(n := name), msg_idx * 10 + ord).n as name,
               arg_max(aor, msg_idx * 10 + ord) as aor from rspa group by all) p
  on p.call_id = i.call_id and p.participant_id = i.pid""")
_block("lp", ["ls", "sp"], """
  select ls.call_id, ls.label, ls.stream_id, sp.participant_id, sp.participant_name, sp.participant_aor
  from ls left join sp using (call_id, stream_id)""")
_block("mdp", ["sto", "plm", "ls"], """
  select s.*, p.label as matched_sdp_label, l.stream_id as matched_siprec_stream_id from sto s
  left join plm p on p.call_id = s.call_id and p.port = s.dst_port
  left join ls l on l.call_id = s.call_id and l.label = p.label""")
_block("ud", ["mdp", "rstr"], """
  select * from rstr r where not exists (select 1 from mdp m where m.call_id = r.call_id and m.matched_siprec_stream_id = r.stream_id)""")
_block("pos", ["mdp", "ud"], """
  select m.* exclude (matched_siprec_stream_id), coalesce(m.matched_siprec_stream_id, q.stream_id) as matched_siprec_stream_id
  from mdp m left join (
    select a.call_id, a.stream_idx, b.stream_id from
      (select call_id, stream_idx, row_number() over (partition by call_id order by stream_idx) as rn,
              count(*) over (partition by call_id) as n from mdp where matched_siprec_stream_id is null) a
    join (select call_id, stream_id, row_number() over (partition by call_id order by msg_idx, ord) as rn,
                 count(*) over (partition by call_id) as n from ud) b
    on a.call_id = b.call_id and a.rn = b.rn and a.n = b.n) q
  on q.call_id = m.call_id and q.stream_idx = m.stream_idx""")
_block("bound", ["pos", "pl", "lp"], """
  select m.* exclude (matched_sdp_label, matched_siprec_stream_id),
         coalesce(a.label, b.label, m.matched_sdp_label) as matched_sdp_label,
         coalesce(l.stream_id, m.matched_siprec_stream_id) as matched_siprec_stream_id,
         l.participant_aor, l.participant_name
  from pos m left join pl a on a.call_id = m.call_id and a.port = m.src_port
  left join pl b on b.call_id = m.call_id and b.port = m.dst_port
  left join lp l on l.call_id = m.call_id and l.label = coalesce(a.label, b.label)""")
_block("ptext", ["bound"], """
  select call_id, label,
         case when coalesce(p.n, '') <> '' and ident <> '' then concat(p.n, ' (', ident, ')')
              else coalesce(nullif(p.n, ''), nullif(ident, '')) end as participant
  from (select *, split_part(regexp_replace(coalesce(p.a, ''), '^[^:]*:', ''), '@', 1) as ident from (
    select call_id, matched_sdp_label as label, arg_min(struct_pack(n := participant_name, a := participant_aor), stream_idx) as p
    from bound where coalesce(matched_sdp_label, '') <> ''
      and (coalesce(participant_name, '') <> '' or coalesce(participant_aor, '') <> '') group by all))""")
_block("dm", ["bound"], """
  select call_id, case when l > 0 then l when t > 0 then t else n end as distinct_media, n as observed from (
    select call_id, count(distinct nullif(matched_sdp_label, '')) as l,
           count(distinct case when coalesce(dst_port, 0) <> 0 then concat(dst_ip, ':', dst_port) end) as t, count(*) as n
    from bound group by call_id)""")
_block("mc", ["sip", "media", "snap", "dm"], """
  select c.call_id, coalesce(v.n, 0) as sdp_count, cast(coalesce(d.declared, 0) as bigint) as declared,
         coalesce(dm.distinct_media, 0) as distinct_media, coalesce(dm.observed, 0) as observed
  from (select distinct call_id from sip) c
  left join (select call_id, max(n) as n from (select call_id, msg_idx, count(*) as n from media
             where media_type in ('audio', 'video') group by all) group by all) v using (call_id)
  left join (select call_id, sum(n_streams) as declared from snap group by all) d using (call_id)
  left join dm using (call_id)""")

# --- lifecycle ------------------------------------------------------------------

_block("seg0", ["bound"], f"""
  select call_id, concat(src_port, '->', dst_port) as port_key,
         coalesce(matched_sdp_label, concat(src_port, '->', dst_port)) as label, matched_sdp_label, stream_idx, ssrc, first_t, last_t, packet_count,
         packet_count >= {MIN_PACKETS} and first_t is not null as solid from bound""")
_block("seg", ["seg0", "rei"], """
  select s.call_id, s.label, s.stream_idx, s.ssrc, s.first_t, s.last_t, s.packet_count, s.port_key,
         (select max(struct_pack(t := r.t_rel, c := r.cseq)) from rei r where r.call_id = s.call_id and r.t_rel <= s.first_t + 0.5::double).c as trigger_cseq,
         lag(s.ssrc) over (partition by s.call_id, s.label order by s.first_t, s.stream_idx) as prev_ssrc,
         row_number() over (partition by s.call_id, s.label order by s.first_t, s.stream_idx) = 1 as is_first
  from seg0 s where s.solid""")
_block("lc", ["seg", "seg0", "ptext"], """
  select g.call_id, g.label, n.lifecycle_ord, p.participant, g.port_key, g.n_segments, g.n_segments - 1 as ssrc_change_count,
         cast(printf('%.3f', (g.n_segments - 1) / greatest(minutes, 1e-6::double)) as double) as stability_per_min, n.noise_stream_count
  from (select call_id, label, arg_min(port_key, struct_pack(a := first_t, b := stream_idx)) as port_key, count(*) as n_segments,
               (max(coalesce(last_t, 0)) - min(first_t)) / 60.0::double as minutes from seg group by all) g
  join (select call_id, label, min(stream_idx) as lifecycle_ord, count(*) filter (not solid) as noise_stream_count from seg0 group by all) n using (call_id, label)
  left join ptext p using (call_id, label)""")
_block("cg", ["seg", "hre", "lc"], """
  select s.call_id, s.label, l.lifecycle_ord, s.stream_idx, l.participant, s.first_t as start_time, s.last_t as end_time,
         s.last_t - s.first_t as duration_s, s.prev_ssrc as old_ssrc, s.ssrc as new_ssrc,
         'SSRC changed on retrieve; a recorder tracking the prior SSRC would miss this audio.' as reason
  from seg s join lc l using (call_id, label)
  where not s.is_first and exists (select 1 from hre h where h.call_id = s.call_id and h.kind = 'RETRIEVE' and abs(s.first_t - h.t_rel) <= 3)""")
_block("col", ["seg", "lc"], """
  select a.call_id, a.label, l.lifecycle_ord, l.port_key, a.ssrc as ssrc_a, b.ssrc as ssrc_b, a.stream_idx as idx_a, b.stream_idx as idx_b,
         greatest(a.first_t, b.first_t) as overlap_start, least(a.last_t, b.last_t) as overlap_end
  from seg a join seg b on a.call_id = b.call_id and a.label = b.label
       and (a.first_t < b.first_t or (a.first_t = b.first_t and a.stream_idx < b.stream_idx))
  join lc l on l.call_id = a.call_id and l.label = a.label
  where a.ssrc is distinct from b.ssrc and a.packet_count > 1 and b.packet_count > 1
    and least(a.last_t, b.last_t) >= greatest(a.first_t, b.first_t)""")
_block("bcl", ["bu", "seg"], """
  select distinct b.call_id, b.burst_idx, s.label from bu b join seg s on s.call_id = b.call_id and not s.is_first
  where s.first_t between b.window_start - 2.0::double and b.window_end + 2.0::double""")
_block("bse", ["bcl", "lc"], """
  select h.call_id, h.burst_idx, l.label, l.lifecycle_ord, coalesce(nullif(l.participant, ''), concat('label ', l.label)) as name,
         exists (select 1 from bcl c where c.call_id = h.call_id and c.burst_idx = h.burst_idx and c.label = l.label) as changed
  from (select distinct call_id, burst_idx from bcl) h join lc l using (call_id)""")

# --- detectors: (call_id, ord, sub, severity, code, title, detail, frames, owner, clause) ----

_SSRC = "case when ssrc is not null then concat('SSRC 0x', printf('%08x', ssrc)) else 'stream' end"


def _rule(name: str, needs: list[str], source: str, order: int, code: str, severity: str, title: str, detail: str,
          owner: str = "null", clause: str = "null", frames: str = "[]", sub: str = "0") -> None:
    def txt(x: str) -> str:
        return x if x.startswith(("=", "(")) else "'" + x.replace("'", "''") + "'"

    def val(x: str) -> str:
        x = txt(x)
        return x[1:] if x.startswith("=") else x

    owner_sql = owner if owner == "null" else val(owner)
    clause_sql = clause if clause == "null" else val(clause)
    _block(name, needs, f"""
  select call_id, {order} as ord, cast([{sub}] as bigint[]) as sub, {val(severity)} as severity, {val(code)} as code,
         {val(title)} as title, {val(detail)} as detail, cast({frames} as bigint[]) as frames,
         cast({owner_sql} as varchar) as owner, cast({clause_sql} as varchar) as clause from {source}""")


_rule("d_nosdp", ["sip"], "(select call_id from sip group by call_id having not bool_or(has_sdp))", 10, "NO_SDP", "ERROR",
      "No SDP found", "No SDP found; RTP/RTCP stream extraction may be incomplete.")
_rule("d_ssrc", ["trans"], "trans where real_changes > 0", 20, "RTP_SSRC_CHANGE", "WARN", "SSRC changed mid-call",
      "=concat(real_changes, ' SSRC change(s) observed mid-call across media flows.', case when noise_changes > 0 then concat(' (', noise_changes, "
      "' additional transition(s) from low-packet-count streams excluded — likely STUN keepalives or RTCP-mux SR noise.)') else '' end)", "SBC")
_rule("d_loss", ["rst"], "rst where fraction_lost_max > 0.05::double", 30, "RTCP_HIGH_LOSS", "WARN", "High RTCP-reported loss",
      f"=concat({_SSRC}, ' reported up to ', printf('%.1f', fraction_lost_max * 100.0::double), '% packet loss on the recording path.')", "NETWORK", sub="coalesce(ssrc, -1)")
_rule("d_rgap", ["rst"], "rst where max_report_gap_s > 10", 31, "RTCP_TIMEOUT", "WARN", "RTCP reporting gap",
      f"=concat({_SSRC}, ' had a ', printf('%.1f', max_report_gap_s), 's gap between RTCP reports (possible media stall or one-way path).')", "NETWORK", sub="coalesce(ssrc, -1)")
_rule("d_rbye", ["rst"], "rst where rtcp_bye_seen", 32, "RTCP_BYE", "INFO", "RTCP BYE observed",
      f"=concat({_SSRC}, ' sent an RTCP BYE (stream ended).')", "UNKNOWN", sub="coalesce(ssrc, -1)")
_rule("d_norep", ["rsum"], "rsum where total > 0 and report_blocks = 0", 33, "RTCP_NO_REPORTS", "WARN", "RTCP present but no quality reports",
      "=concat(total, ' RTCP packet(s) seen (', sr, ' SR, ', rr, ' RR, ', sdes, ' SDES) but none carried a reception report block, so packet loss, jitter, and MOS cannot be computed from this capture.', "
      "case when muxed_as_rtp > 0 then concat(' ', muxed_as_rtp, ' of these were rtcp-mux''d onto the RTP port and dissected as RTP; re-run with rtcp-mux decoding to recover any report blocks.') "
      "else ' The receiving side (recorder) is not sending Receiver Reports, or only one direction was captured.' end)", "UNKNOWN")
_rule("d_mos", ["est"], "est where mos_min < 3.6::double", 40, "=case when mos_min < 2.6::double then 'MOS_BAD' else 'MOS_LOW' end",
      "=case when mos_min < 2.6::double then 'ERROR' else 'WARN' end", "=concat('Low call quality (MOS ', printf('%.1f', mos_min), ')')",
      f"=concat(coalesce(nullif(participant, ''), case when label <> '' then concat('label ', label) end , {_SSRC}), ' (', codec, ') reached a ', case when mos_min < 2.6::double then 'poor' else 'degraded' end, ' MOS of ', printf('%.1f', mos_min), "
      "' (avg ', printf('%.1f', mos_avg), '); avg loss ', printf('%.1f', loss_pct_avg), '%, avg jitter ', printf('%.0f', jitter_ms_avg), 'ms, assumed one-way delay ', printf('%.0f', one_way_delay_ms), 'ms.')",
      "NETWORK", sub="coalesce(ssrc, -1)")
_rule("d_label", ["rstr", "bound"], "(select call_id, list_sort(list(distinct label)) as ls from rstr group by call_id) where call_id not in (select call_id from bound where coalesce(matched_sdp_label, '') <> '')",
      50, "SIPREC-005", "WARN", "SIPREC labels not bound to any RTP stream",
      "=concat('Metadata declared label(s) [''', array_to_string(ls, ''', '''), '''] but none could be matched to an observed SSRC by port. SSRC-level diagnosis is limited.')", "SBC")
_block("bh", ["bound", "hw"], """
  select b.*, exists (select 1 from hw h where h.call_id = b.call_id and b.first_t >= h.hold_start and b.last_t <= coalesce(h.hold_end, 'infinity'::double)) as in_hold,
         case when b.matched_siprec_stream_id <> '' then concat('stream ', b.matched_siprec_stream_id)
              when b.ssrc is not null then concat('SSRC 0x', printf('%08x', b.ssrc)) else concat(b.dst_ip, ':', b.dst_port) end as sname from bound b""")
_rule("d_none", ["mc"], "mc where declared > 0 and observed = 0", 60, "RTP_NONE_OBSERVED", "ERROR", "No RTP observed",
      "=concat('Metadata declares ', declared, ' stream(s) but no RTP streams were observed in the capture.')")
_rule("d_seq", ["bh"], "bh where sequence_gaps > 0 and not in_hold", 61, "RTP_SEQ_GAP", "WARN", "RTP sequence gaps",
      "=concat(sequence_gaps, ' RTP sequence gap(s) on ', sname, ' (largest ', largest_gap, ').')", sub="stream_idx * 4")
_rule("d_nortcp", ["bh"], "bh where not rtcp_observed and not in_hold", 61, "RTP_MISSING_RTCP", "WARN", "Missing RTCP",
      "=concat('No RTCP observed for ', sname, '.')", sub="stream_idx * 4 + 1")
_rule("d_late", ["bh", "tl"], "(select * from bh join tl using (call_id)) where first_t - established_at > 2.0::double", 61, "RTP_LATE_START", "WARN", "Media started late",
      "=concat(sname, ' RTP started ', printf('%.2f', first_t - established_at), 's after session establishment.')", sub="stream_idx * 4 + 2")
_rule("d_early", ["bh", "tl"], "(select * from bh join tl using (call_id)) where established_at is not null and terminated_at - last_t > 2.0::double", 61, "RTP_EARLY_END", "WARN", "Media ended early",
      "=concat(sname, ' RTP ended ', printf('%.2f', terminated_at - last_t), 's before session termination.')", sub="stream_idx * 4 + 3")
_rule("d_cmr", ["mc"], "mc where declared > 0 and distinct_media < declared", 70, "CONSIST_METADATA_RTP", "ERROR", "Metadata declares more streams than were recorded",
      "=concat('The SBC''s own metadata declared ', declared, ' stream(s) but only ', distinct_media, ' carried media to the recorder. The SBC''s metadata and the media it sent disagree.')", "SBC")
_rule("d_cms", ["mc"], "mc where declared > 0 and sdp_count > 0 and sdp_count <> declared", 71, "CONSIST_METADATA_SDP", "WARN", "Metadata / SDP stream-count mismatch",
      "=concat('Metadata declares ', declared, ' stream(s); SDP offers ', sdp_count, ' media section(s).')", "SBC")
_rule("d_csr", ["mc"], "mc where sdp_count > 0 and distinct_media > sdp_count", 72, "CONSIST_SDP_RTP", "WARN", "More RTP streams than SDP declared",
      "=concat('SDP offered ', sdp_count, ' media section(s) but ', distinct_media, ' RTP stream(s) were observed.')", "SBC")
_rule("d_burst", ["bu"], "bu", 80, "SIP_REINVITE_BURST", "WARN", "Re-INVITE burst",
      "=concat(\"count\", ' re-INVITE/UPDATE messages within ', printf('%.1f', window_end - window_start), 's (starting at t=', printf('%.1f', window_start), 's).', "
      "case when codec_renegotiation then ' Offered codec set changed across the burst — consistent with codec renegotiation.' else '' end)", "SBC", frames="frames", sub="burst_idx")
_rule("d_rx", ["rx"], "rx", 90, "SIP_RETRANSMISSION", "WARN", "SIP retransmission",
      "=concat(case when kind = 'Q' then what else concat(what, ' response') end, ' (CSeq ', cseq, ') was transmitted ', n, ' times — suggests packet loss or an unresponsive peer.')",
      "NETWORK", frames="frames", sub="first_idx")
_rule("d_fail", ["sf"], "sf where status_code >= 400", 91, "SIP_FAILURE_RESPONSE", "=case when status_code >= 500 then 'ERROR' else 'WARN' end",
      "=concat('SIP ', status_code, ' failure response')",
      "=concat(trim(concat(status_code, ' ', coalesce(reason_phrase, ''))), ' — ', case status_code when 408 then 'Request Timeout — no timely response from the peer.' "
      "when 488 then 'Not Acceptable Here — typically a codec mismatch.' else 'Service Unavailable — peer overloaded or marked down.' end)",
      "UNKNOWN", frames="[frame_number]", sub="msg_idx")
_rule("d_noack", ["noack"], "noack", 92, "SIP_MISSING_ACK", "ERROR", "Missing ACK",
      "A 200 OK to INVITE was seen but no ACK followed — the dialog never completed.", "UNKNOWN")
_rule("d_slow", ["pdd"], "pdd where pdd_s > 6.0::double", 93, "SIP_SLOW_ANSWER", "WARN", "Slow answer (post-dial delay)",
      "=concat('INVITE to 200 OK took ', printf('%.1f', pdd_s), 's.')", "UNKNOWN")
_rule("d_timer", ["timer"], "timer where is_refresh", 94, "SIP_SESSION_TIMER_REFRESH", "INFO", "Session-timer refresh pattern",
      "=concat('Re-INVITE/UPDATE recurring roughly every ', printf('%.0f', avg_s), 's — looks like a session-timer refresh, not a fault.')", "UNKNOWN")
_rule("d_nomd", ["sip", "snap"], "(select distinct call_id from sip) where call_id not in (select call_id from snap)", 100, "SIPREC_NO_METADATA", "ERROR", "No SIPREC metadata",
      "The recording INVITE carried no application/rs-metadata body.", "SBC", "RFC 7866 §6")
_rule("d_mdinv", ["snap"], "snap where n_sessions = 0 and n_participants = 0 and n_streams = 0", 102, "SIPREC_METADATA_INVALID", "ERROR", "SIPREC metadata invalid or empty",
      "Metadata XML was present but contained no session, participant, or stream elements.", "SBC", "RFC 7865 §6", sub="msg_idx")
_rule("d_mdinc", ["snap"], "snap where n_streams > 0 and n_participants = 0", 102, "SIPREC_METADATA_INCOMPLETE", "WARN", "SIPREC metadata incomplete",
      "Metadata is missing required element(s): participant.", "SBC", "RFC 7865 §7", sub="msg_idx")
_block("same", ["snap"], """
  select call_id, count(*) as n_snapshots from snap group by call_id having count(*) > 1 and count(distinct trim(raw_xml)) = 1""")
_rule("d_same", ["same"], "same", 103, "SIPREC_NO_VERSION_INCREMENT", "WARN", "Metadata not updated across snapshots",
      "Multiple metadata bodies were sent but all were identical — updates should reflect state changes.", "SBC", "RFC 7865 §6")
_block("inv", ["sip"], "select * from sip where method = 'INVITE' qualify row_number() over (partition by call_id order by msg_idx) = 1")
_rule("d_dir", ["inv", "media", "snap"], "(select i.call_id, i.frame_number, m.direction, m.media_idx from inv i join media m using (call_id, msg_idx) where i.call_id in (select call_id from snap)) where direction not in ('sendonly', 'inactive')",
      104, "SIPREC_BAD_DIRECTION", "WARN", "Unexpected media direction to recorder",
      "=concat('Recording offer has a=', direction, ' on a media line; the SRC should offer sendonly to the SRS.')", "SBC", "RFC 7866 §7.1.1", frames="[frame_number]", sub="media_idx")
_block("orig", ["sf", "ends"], """
  select s.* exclude (src_ip), s.src_ip, case when s.status_code >= 400 then 'failure' else 'bye' end as kind,
         case when s.src_ip = e.src_ip then 'SBC' when s.src_ip = e.srs_ip then 'GENESYS' else 'UNKNOWN' end as owner,
         case when s.src_ip = e.src_ip then 'SBC' when s.src_ip = e.srs_ip then 'Genesys/SRS' else s.src_ip end as who
  from sf s join ends e using (call_id) where s.status_code >= 400 or (s.is_request and s.cm = 'BYE')""")
_rule("d_eo", ["orig"], "orig where kind = 'failure'", 110, "=concat('ERR_ORIGIN_', case when owner = 'GENESYS' then 'GENESYS' else 'SBC' end)",
      "=case when status_code >= 500 then 'ERROR' else 'WARN' end", "=concat(status_code, ' emitted by ', who)",
      "=concat('A ', status_code, ' ', coalesce(reason_phrase, ''), ' response was sent from ', src_ip, ' (', who, ').')", "=owner", frames="[frame_number]", sub="msg_idx")
_rule("d_bo", ["orig"], "orig where kind = 'bye'", 110, "=concat('BYE_ORIGIN_', case when owner = 'GENESYS' then 'GENESYS' else 'SBC' end)", "INFO", "=concat('BYE sent by ', who)",
      "=concat('The recording dialog was terminated by a BYE from ', src_ip, ' (', who, ').')", "=owner", frames="[frame_number]", sub="msg_idx")
_rule("d_hold", ["hre"], """(select call_id, count(*) filter (kind = 'RETRIEVE') as cycles, list(frame_number order by msg_idx) as frames,
       string_agg(concat(kind, ' at ', case when t_rel is null then 't=?' else concat('t=', printf('%.1f', t_rel), 's') end, ' (CSeq ', cseq, ')'), '; ' order by msg_idx) as events
       from hre group by call_id)""", 120, "SIPREC-004", "INFO", "Hold/retrieve cycle detected",
      "=concat(cycles, ' hold/retrieve cycle(s): ', events, '.')", "SBC", "RFC 3264 §8.4", frames="frames")
_WHO = "coalesce(nullif(participant, ''), concat('label ', label))"


def _hx(c: str) -> str:
    return f"case when {c} is null then '?' else concat('0x', printf('%08x', {c})) end"


_rule("d_gap", ["cg"], "cg", 130, "SIPREC-001", "CRITICAL", "Recording gap after retrieve (SSRC change)",
      f"=concat('Stream ', {_WHO}, ' changed SSRC from ', {_hx('old_ssrc')}, ' to ', {_hx('new_ssrc')}, ' at t=', printf('%.1f', start_time), 's on retrieve. Estimated recording gap: ', printf('%.0f', duration_s), 's. Verify the recorder followed the new SSRC.')",
      "SBC", sub="lifecycle_ord, stream_idx")
_rule("d_col", ["col"], "col", 131, "SIPREC-003", "ERROR", "Two SSRCs active on one media port",
      f"=concat('On label ', label, ' (', port_key, '), SSRCs ', {_hx('ssrc_a')}, ' and ', {_hx('ssrc_b')}, ' overlapped between t=', printf('%.1f', overlap_start), 's and t=', printf('%.1f', overlap_end), 's — the recorder may capture the wrong one.')",
      "SBC", sub="lifecycle_ord, idx_a, idx_b")
_rule("d_churn", ["lc", "seg"], f"(select l.*, c.chain from lc l join (select call_id, label, string_agg({_hx('ssrc')}, ' -> ' order by first_t, stream_idx) as chain from seg group by all) c using (call_id, label)) where ssrc_change_count > 0",
      132, "SIPREC-002", "=case when stability_per_min >= 1 then 'WARN' else 'INFO' end", "SSRC churn on a stream",
      f"=concat({_WHO}, ' changed SSRC ', ssrc_change_count, ' time(s) (', stability_per_min, '/min): ', chain)", "SBC", sub="lifecycle_ord")
_rule("d_bchurn", ["bse", "bu"], """(select b.*, e.moved, e.still from bu b join (select call_id, burst_idx, string_agg(name, ', ' order by lifecycle_ord, name) filter (changed) as moved,
       coalesce(string_agg(name, ', ' order by lifecycle_ord, name) filter (not changed), '') as still from bse group by all) e using (call_id, burst_idx))""", 133, "SIPREC-002", "WARN",
      "Re-INVITE burst caused SSRC churn",
      "=concat('Re-INVITE burst at t=', printf('%.0f', window_start), 's coincided with SSRC change(s) on: ', moved, '.', case when still <> '' then concat(' Asymmetric: ', still, ' did not change — the SBC handled the legs differently.') else '' end)",
      "SBC", frames="frames", sub="burst_idx")
_rule("d_mux", ["muxn"], "muxn where rtcp_on_media_ports > 0", 140, "SIPREC-006", "INFO", "RTCP-mux packets on the RTP port",
      "=concat(rtcp_on_media_ports, ' RTCP packet(s) were observed on the RTP media port (rtcp-mux); these are excluded from the stream table.')", "UNKNOWN")
_rule("d_mix1", ["mc"], "mc where declared = observed and declared > 0", 160, "MIX_STREAMS_OK", "INFO", "Stream count consistent", "=concat(declared, ' declared / ', observed, ' observed RTP stream(s).')")
_rule("d_mix2", ["mc"], "mc where observed = 0 and declared > 0", 160, "MIX_NONE_OBSERVED", "ERROR", "No observed streams", "=concat(declared, ' stream(s) declared but none observed.')")
_rule("d_mix3", ["mc"], "mc where observed > 0 and observed < declared", 160, "MIX_FEWER_OBSERVED", "WARN", "Fewer observed than declared", "=concat(declared, ' declared / ', observed, ' observed RTP stream(s); at least one declared stream is missing.')")
_rule("d_mix4", ["mc"], "mc where observed > declared", 160, "MIX_MORE_OBSERVED", "WARN", "More observed than declared", "=concat(declared, ' declared / ', observed, ' observed RTP stream(s); extra RTP streams have no matching declared metadata.')")
_rule("d_mix5", ["mc"], "mc where declared > 0 and sdp_count > 0 and sdp_count <> declared", 161, "MIX_SDP_COUNT_MISMATCH", "WARN", "SDP m-line / metadata mismatch", "=concat('SDP declares ', sdp_count, ' media section(s) but metadata declares ', declared, ' stream(s).')")

DETECTORS = (
    "d_nosdp", "d_ssrc", "d_loss", "d_rgap", "d_rbye", "d_norep", "d_mos", "d_label", "d_none", "d_seq", "d_nortcp", "d_late",
    "d_early", "d_cmr", "d_cms", "d_csr", "d_burst", "d_rx", "d_fail", "d_noack", "d_slow", "d_timer", "d_nomd", "d_mdinv",
    "d_mdinc", "d_same", "d_dir", "d_eo", "d_bo", "d_hold", "d_gap", "d_col", "d_churn", "d_bchurn", "d_mux",
)
_OWNER_CASE = """coalesce(owner, case when code in ('NO_SDP', 'RTP_NONE_OBSERVED', 'RTP_LATE_START', 'RTP_EARLY_END') then 'SBC'
    when code in ('RTP_SEQ_GAP', 'RTP_MISSING_RTCP') then 'NETWORK' else 'UNKNOWN' end)"""
_block("fnd", list(DETECTORS), "select * replace (" + _OWNER_CASE + " as owner) from (" + " union all ".join(f"select * from {d}" for d in DETECTORS) + ")")
_block("facts", ["sip", "span", "ends", "snap", "bound", "rsum", "fnd"], """
  select s.call_id, f.has_sdp, f.has_metadata, s.start_epoch, s.end_epoch, s.n_epochs, s.n_messages,
         e.src_ip, e.src_port, e.srs_ip, e.srs_port, cast(coalesce(d.n, 0) as bigint) as declared, coalesce(b.n, 0) as observed,
         cast(coalesce(b.g, 0) as bigint) as gaps_total, coalesce(b.m, 0) as missing_rtcp, b.ft as first_media_t,
         coalesce(r.total, 0) as rtcp_total, coalesce(r.report_blocks, 0) as report_blocks, coalesce(r.sr, 0) as sr, coalesce(r.rr, 0) as rr,
         coalesce(x.n, 0) as n_findings, coalesce(x.w, 0) as n_warnings, coalesce(x.e, 0) as n_errors, coalesce(x.worst, 0) as worst
  from span s join ends e using (call_id)
  join (select call_id, bool_or(has_sdp) as has_sdp, bool_or(has_metadata) as has_metadata from sip group by all) f using (call_id)
  left join (select call_id, sum(n_streams) as n from snap group by all) d using (call_id)
  left join (select call_id, count(*) as n, sum(sequence_gaps) as g, count(*) filter (not rtcp_observed) as m, min(first_t) as ft from bound group by all) b using (call_id)
  left join rsum r using (call_id)
  left join (select call_id, count(*) as n, count(*) filter (severity = 'WARN') as w, count(*) filter (severity in ('ERROR', 'CRITICAL')) as e,
             max(case severity when 'PASS' then 0 when 'INFO' then 1 when 'WARN' then 2 when 'ERROR' then 3 else 4 end) as worst from fnd group by all) x using (call_id)""")
_block("hl", ["facts"], """
  select * exclude (worst), ['PASS', 'INFO', 'WARN', 'ERROR', 'CRITICAL'][1 + greatest(worst,
           case when status_sdp = 'ERROR' or status_rtp = 'ERROR' or status_streams = 'ERROR' then 3 else 0 end,
           case when 'WARN' in (status_metadata, status_rtcp, status_streams, status_gaps) then 2 else 0 end)] as overall_health
  from (select *, 'PASS' as status_sip, case when has_sdp then 'PASS' else 'ERROR' end as status_sdp,
               case when has_metadata then 'PASS' else 'WARN' end as status_metadata,
               case when observed > 0 then 'PASS' else 'ERROR' end as status_rtp,
               case when observed > 0 and report_blocks > 0 then 'PASS' else 'WARN' end as status_rtcp,
               case when declared = observed and declared > 0 then 'PASS' when observed < declared and observed = 0 then 'ERROR' else 'WARN' end as status_streams,
               case when gaps_total > 0 then 'WARN' else 'PASS' end as status_gaps from facts)""")
_block("fp", ["sip", "ends"], """
  select a.call_id, a.actor, a.ip,
         arg_min(nullif(user_agent, ''), msg_idx) filter (nullif(user_agent, '') is not null) as user_agent,
         arg_min(nullif(server, ''), msg_idx) filter (nullif(server, '') is not null) as server,
         arg_min(regexp_extract(contact, '@([^>;[:space:]]+)', 1), msg_idx) filter (contact is not null) as contact_host,
         arg_min(via_sent_by, msg_idx) as via_sent_by,
         arg_min(split_part(sdp_origin, ' ', 6), msg_idx) filter (sdp_origin is not null) as sdp_origin_addr
  from (select call_id, 'SRC/SBC' as actor, src_ip as ip from ends union all select call_id, 'SRS/recorder', srs_ip from ends) a
  left join sip s on s.call_id = a.call_id and s.src_ip = a.ip where a.ip is not null group by all""")
_block("ckp", ["sip", "rspa", "bound"], """
  select distinct call_id, kind, value from (
    select call_id, 'aor' as kind, aor as value from rspa where coalesce(aor, '') <> ''
    union all
    select call_id, 'aor', regexp_extract(h, '(?i)sip:[^>;[:space:]]+') from (
      select call_id, unnest([from_header, to_header]) as h from sip where call_id not in (select call_id from rspa where coalesce(aor, '') <> ''))
    union all select call_id, 'tuple', concat(src_ip, ':', src_port, '->', dst_ip, ':', dst_port) from bound
    union all select call_id, 'ssrc', concat('0x', printf('%08x', ssrc)) from bound where ssrc is not null)
  where value <> ''""")
_block("nar", ["facts", "tl", "dm", "bu", "hre", "cg", "chg", "fnd", "inv", "sf"], """
  select call_id, row_number() over (partition by call_id order by section, sub, text) as "index", text, frame_number from (
    select i.call_id, 1 as section, [0]::bigint[] as sub,
           concat(case when i.src_ip = f.src_ip then 'the SBC' when i.src_ip = f.srs_ip then 'the recorder' else i.src_ip end, ' sent an INVITE to ',
                  case when i.dst_ip = f.src_ip then 'the SBC' when i.dst_ip = f.srs_ip then 'the recorder' else i.dst_ip end,
                  case when declared > 0 then concat(' carrying SIPREC metadata that declared ', declared, ' stream(s)') else ' (no SIPREC metadata present)' end, '.') as text,
           i.frame_number from inv i join facts f using (call_id)
    union all
    select s.call_id, 2, [0]::bigint[], concat(case when s.src_ip = f.src_ip then 'the SBC' when s.src_ip = f.srs_ip then 'the recorder' else s.src_ip end,
           ' answered ', s.status_code, ' ', coalesce(s.reason_phrase, ''), '.'), s.frame_number
    from (select * from sf where status_code between 200 and 299 qualify row_number() over (partition by call_id order by msg_idx) = 1) s join facts f using (call_id)
    union all
    select * from (select f.call_id, 3, [0]::bigint[], case when observed > 0 and first_media_t - established_at > 2.0::double
           then concat('RTP to the recorder did not start until ', printf('%.1f', first_media_t - established_at), 's after the session was established (clipped start).')
           when observed > 0 and first_media_t - established_at is not null then 'RTP began flowing to the recorder shortly after answer.'
           when observed = 0 and declared > 0 then 'No RTP reached the recorder at all, despite metadata declaring media.' end as text, null from facts f join tl using (call_id)) where text is not null
    union all
    select call_id, 4, [burst_idx]::bigint[], concat('A burst of ', "count", ' re-INVITE/UPDATE messages occurred around t=', printf('%.0f', window_start), 's',
           case when codec_renegotiation then ' and the offered codec set changed (codec renegotiation)' else '' end, '.'), null from bu
    union all
    select call_id, 5, [msg_idx]::bigint[], concat('The call was ', case when kind = 'HOLD' then 'placed on hold' else 'retrieved' end, ' at ',
           case when t_rel is null then 'an unknown time' else concat('t=', printf('%.1f', t_rel), 's') end, ' (CSeq ', cseq, ').'), frame_number from hre
    union all
    select call_id, 6, [lifecycle_ord, stream_idx]::bigint[], concat('After retrieve, ', coalesce(nullif(participant, ''), concat('label ', label)), ' changed SSRC from 0x', printf('%08x', coalesce(old_ssrc, 0)),
           ' to 0x', printf('%08x', coalesce(new_ssrc, 0)), '; if the recorder did not follow the new SSRC, about ', printf('%.0f', duration_s), 's of that stream''s audio is missing.'), null from cg
    union all
    select call_id, 7, [0]::bigint[], concat('The media SSRC changed ', count(*), ' time(s) mid-call, indicating the feed was restarted.'), null from chg
    where call_id not in (select call_id from cg) group by call_id
    union all
    select call_id, 8, list_concat([ord]::bigint[], sub), concat('A problem was detected: ', title, ' — ', detail), null from fnd where severity in ('ERROR', 'CRITICAL')
    union all
    select s.call_id, 9, [0]::bigint[], concat('The recording dialog was ended by a BYE from ', case when s.src_ip = f.src_ip then 'the SBC' when s.src_ip = f.srs_ip then 'the recorder' else s.src_ip end, '.'), s.frame_number
    from (select * from sf where is_request and method = 'BYE' qualify row_number() over (partition by call_id order by msg_idx) = 1) s join facts f using (call_id)
    union all
    select call_id, 9, [0]::bigint[], 'No BYE was seen — the recording dialog did not close cleanly in this capture.', null from tl
    where terminated_at is null and call_id not in (select call_id from sf where is_request and method = 'BYE')
    union all
    select f.call_id, 10, [0]::bigint[], case when declared > 0 then concat('In total, ', coalesce(d.distinct_media, 0), ' of ', declared, ' declared stream(s) carried media to the recorder.')
           else concat('In total, ', coalesce(d.distinct_media, 0), ' RTP stream(s) were observed.') end, null from facts f left join dm d using (call_id))""")


def _order(names) -> tuple[list[str], list[str]]:
    views: list[str] = []
    blocks: list[str] = []

    def add(n: str) -> None:
        if n in VIEW_NEEDS:
            if n not in views:
                views.append(n)
            return
        for d in _B[n][0]:
            add(d)
        if n not in blocks:
            blocks.append(n)

    for n in names:
        add(n)
    return views, blocks


def sql(select: str, *names: str) -> str:
    """A full statement over the named blocks and views."""
    views, blocks = _order(names)
    parts = [cte("duckdb", *views)] if views else []
    parts += [f"{b} as ({_B[b][1]})" for b in blocks]
    head = "with recursive " if "walk" in blocks else "with "
    return (head + ",\n".join(parts) + "\n" if parts else "") + select
