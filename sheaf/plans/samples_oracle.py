"""DuckDB oracle SQL for the memory-sample queries (typed ``events`` columns)."""

F4 = """
t as (select user_id run_id, event_id seq, cast(floor(epoch(ts)) as bigint) epoch_s, value rss_mb, value + 300 vms_mb,
  2000 - 4 * value available_mb, cast(event_id % 100 as double) percent from events),
s as (select *, epoch_s - min(epoch_s) over (partition by run_id) elapsed_s from t),
st0 as (select run_id, count(*) n_samples, arg_min(epoch_s, (epoch_s, seq)) b_t, arg_min(rss_mb, (epoch_s, seq)) b_rss,
  arg_min(vms_mb, (epoch_s, seq)) b_vms, arg_max(epoch_s, (epoch_s, seq)) a_t, arg_max(rss_mb, (epoch_s, seq)) a_rss,
  arg_max(vms_mb, (epoch_s, seq)) a_vms, max((epoch_s, seq)) last_pos from s group by run_id),
pk as (select s.run_id, arg_max(seq, (rss_mb, -epoch_s, -seq)) p_seq, max(rss_mb) p_rss from s join st0 using (run_id)
  where (s.epoch_s, s.seq) < st0.last_pos group by s.run_id),
st as (select st0.*, coalesce(pk.p_seq, (select min(seq) from s where s.run_id = st0.run_id and s.epoch_s = st0.b_t)) p_seq,
  coalesce(pk.p_rss, b_rss) p_rss, cast(a_t - b_t as double) duration_seconds, a_rss - b_rss rss_delta_mb,
  a_vms - b_vms vms_delta_mb from st0 left join pk using (run_id)),
rp as (select run_id, seq, rss_mb, max(rss_mb) over (partition by run_id order by epoch_s, seq rows between unbounded preceding and current row) running_peak,
  max(rss_mb) over (partition by run_id order by epoch_s, seq rows between unbounded preceding and 1 preceding) prev_peak from s)
"""


OUTCOMES = """oc as (select user_id run_id, 'failed at event ' || cast(max(event_id) filter (where last) as varchar) error from (
  select *, row_number() over (partition by user_id order by floor(epoch(ts)) desc, event_id desc) = 1 last from events) e
  group by user_id having max(event_type) filter (where last) = 'error')"""


def _w(body):
    return "with " + F4 + body


ORACLE = {
    "samples_scan": _w("""select run_id, seq, epoch_s, round(rss_mb, 6) rss_mb, round(vms_mb, 6) vms_mb,
  round(available_mb, 6) available_mb, round(percent, 6) percent, elapsed_s from s"""),
    "job_mem_stats": _w("""select run_id, n_samples, b_t before_epoch_s, round(b_rss, 6) before_rss_mb, a_t after_epoch_s,
  round(a_rss, 6) after_rss_mb, p_seq peak_seq, round(p_rss, 6) peak_rss_mb, round(duration_seconds, 6) duration_seconds,
  round(rss_delta_mb, 6) rss_delta_mb, round(vms_delta_mb, 6) vms_delta_mb from st"""),
    "snapshot_delta": _w("select run_id, round(rss_delta_mb, 6) rss_delta_mb, round(vms_delta_mb, 6) vms_delta_mb from st"),
    "job_status_line": _w(f""", {OUTCOMES}
  select run_id, case when error is null then '[SUCCESS]' else '[FAILED]' end || printf(' run_%d | Duration: %.2fs | RSS Delta: %+.2fMB | VMS Delta: %+.2fMB | Peak RSS: %.2fMB',
  run_id, duration_seconds, rss_delta_mb, vms_delta_mb, p_rss) line from st left join oc using (run_id)"""),
    "running_peak": _w("select run_id, seq, round(running_peak, 6) running_peak from rp"),
    "peak_updates": _w("select run_id, seq, prev_peak is null or rss_mb > prev_peak is_new_peak from rp"),
    "limit_verdict": _w("""select run_id, arg_min(seq, (epoch_s, seq)) seq, arg_min(code, (epoch_s, seq)) returncode,
  arg_min(msg, (epoch_s, seq)) message from (select *, case when elapsed_s > 259200 then -1 when rss_mb > 400 then -2
  when available_mb < 500 then -3 end code, case when elapsed_s > 259200 then 'Timeout after 259200s'
  when rss_mb > 400 then printf('Memory limit exceeded: %.1fMB', rss_mb) else 'System low on memory' end msg from s)
  where code is not null group by run_id"""),
    "profiler_totals": _w("""select count(*) total_jobs, round(sum(rss_delta_mb), 6) total_rss_delta_mb,
  arg_max(run_id, (rss_delta_mb, -b_t, -(select min(seq) from s where s.run_id = st.run_id and s.epoch_s = st.b_t))) max_delta_run,
  round(max(rss_delta_mb), 6) max_rss_delta_mb,
  arg_max(run_id, (p_rss, -b_t, -(select min(seq) from s where s.run_id = st.run_id and s.epoch_s = st.b_t))) max_peak_run,
  round(max(p_rss), 6) max_peak_rss_mb from st"""),
    "oom_culprits": _w("""select run_id, round(rss_delta_mb, 6) rss_delta_mb, round(p_rss, 6) peak_rss_mb from st
  where rss_delta_mb > 50 or p_rss > 500"""),
    "culprits_sorted": _w("select run_id, round(rss_delta_mb, 6) rss_delta_mb from st where rss_delta_mb > 100 or p_rss > 450"),
    "high_memory_jobs": _w("select count(*) filter (where rss_delta_mb > 100) high_memory_runs, count(*) runs from st"),
}

ORACLE["monitor_emit"] = """with recursive
s0 as (select user_id run_id, event_id seq, cast(floor(epoch(ts)) as bigint) epoch_s, value rss_mb from events),
s1 as (select *, max(rss_mb) over (partition by run_id order by epoch_s, seq rows between unbounded preceding and 1 preceding) prev_peak,
  max(rss_mb) over (partition by run_id order by epoch_s, seq rows between unbounded preceding and current row) running_peak,
  row_number() over (partition by run_id order by epoch_s, seq) rn from s0),
m as (select *, rss_mb > prev_peak new_peak from s1 where rn > 1),
r as (select run_id, rn, (new_peak or epoch_s >= 43200) emit, case when new_peak or epoch_s >= 43200 then epoch_s else 0 end last
  from m where rn = 2
  union all
  select m.run_id, m.rn, (m.new_peak or m.epoch_s - r.last >= 43200),
    case when m.new_peak or m.epoch_s - r.last >= 43200 then m.epoch_s else r.last end
  from r join m on m.run_id = r.run_id and m.rn = r.rn + 1)
select m.run_id, m.seq, m.epoch_s, round(m.rss_mb, 6) rss_mb, round(m.running_peak, 6) peak_rss_mb, m.new_peak
from r join m using (run_id, rn) where r.emit"""

ORACLE["memory_spikes"] = """with recursive
s0 as (select user_id run_id, event_id seq, cast(floor(epoch(ts)) as bigint) epoch_s, value rss_mb,
  row_number() over (partition by user_id order by cast(floor(epoch(ts)) as bigint), event_id) rn from events),
r as (select run_id, rn, rss_mb > 100.0 hit, case when rss_mb > 100.0 then rss_mb else 0.0 end last from s0 where rn = 1
  union all
  select s0.run_id, s0.rn, s0.rss_mb > r.last + 100.0, case when s0.rss_mb > r.last + 100.0 then s0.rss_mb else r.last end
  from r join s0 on s0.run_id = r.run_id and s0.rn = r.rn + 1)
select s0.run_id, s0.seq, s0.epoch_s, round(s0.rss_mb, 6) rss_mb from r join s0 using (run_id, rn) where r.hit"""
