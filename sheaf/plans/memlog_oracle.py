"""DuckDB oracle SQL for the leak-analysis queries.

Reads the typed ``events`` columns directly (no text), so the Spark side's
parser is checked rather than mirrored. Pairing uses a correlated MAX over
earlier STARTs, a different formulation from the Spark carry-forward.
"""

LIMIT = "cast(2048.0 as double)"

F1_TYPED = """
t as (select event_id line_no, date_trunc('second', ts) ts, 'job_' || cast(user_id % 20 as varchar) job,
  event_type, cast(value as decimal(14,2)) v,
  cast(event_id % 7 - 2 + case when user_id % 20 = 7 then 25 else 0 end as decimal(14,2)) d,
  cast(event_id % 11 - 4 as decimal(14,2)) vd,
  cast((user_id % 20) * (event_id - event_id % 100) * 0.01 as decimal(14,2)) g,
  cast(event_id % 90 as decimal(14,2)) dur, cast(event_id % 100 as decimal(14,2)) pct from events),
e0 as (select line_no, ts, job job_name,
  case when event_type = 'view' then 'START'
       when event_type = 'purchase' and cast(v + g + d as decimal(14,2)) >= 0 then 'END'
       when event_type = 'click' then 'MONITOR' end log_type,
  case when event_type = 'view' then cast(v as double) end rss_mb,
  case when event_type = 'view' then cast(cast(v + 300 as decimal(14,2)) as double) end vms_mb,
  case when event_type = 'purchase' then cast(cast(v + g as decimal(14,2)) as double) end rss_before,
  case when event_type = 'purchase' then cast(cast(v + g + d as decimal(14,2)) as double) end rss_after,
  case when event_type = 'purchase' then cast(d as double) end rss_delta,
  case when event_type = 'purchase' then cast(vd as double) end vms_delta,
  case when event_type = 'purchase' then cast(cast(v + g + 50 as decimal(14,2)) as double) end peak_rss,
  case when event_type = 'click' then cast(v as double) end current_rss_mb,
  case when event_type = 'click' then cast(cast(v + g + 50 as decimal(14,2)) as double) end peak_rss_mb,
  case when event_type = 'purchase' then cast(dur as double) end duration,
  case when event_type in ('view', 'click') then cast(pct as double) end memory_percent,
  case when event_type = 'view' then cast(cast(8000 - v as decimal(14,2)) as double) end system_available_mb,
  case when event_type = 'click' then cast(dur as double) end elapsed
  from t),
e as (select * from e0 where log_type is not null),
pairs as (select en.line_no, en.job_name, en.ts end_ts,
  (select max(s.ts) from e s where s.log_type = 'START' and s.job_name = en.job_name
     and (s.ts < en.ts or (s.ts = en.ts and s.line_no < en.line_no))) start_ts
  from e en where en.log_type = 'END'),
st as (select job_name, ts, arg_max(rss_mb, line_no) rss, arg_max(vms_mb, line_no) vms,
  arg_max(memory_percent, line_no) pct, arg_max(system_available_mb, line_no) avail
  from e where log_type = 'START' group by job_name, ts),
orph as (select job_name, ts start_time, coalesce(rss, 0.0) rss_at_start, coalesce(vms, 0.0) vms_at_start,
  coalesce(pct, 0.0) memory_percent_at_start, coalesce(avail, 0.0) system_available_at_start
  from st where not exists (select 1 from pairs p where p.job_name = st.job_name and p.start_ts = st.ts)),
es as (select job_name, count(*) run_count, count(rss_delta) n_deltas, avg(rss_delta) avg_d, sum(rss_delta) tot_d,
  stddev_samp(rss_delta) sd_d, avg(vms_delta) avg_v, avg(peak_rss) avg_p, max(peak_rss) max_p,
  count(rss_after) n_pts, regr_slope(rss_after, epoch(ts)) slope, arg_min(rss_after, line_no) first_a,
  arg_max(rss_after, line_no) last_a from e where log_type = 'END' group by job_name),
oc as (select job_name, count(*) orphaned_count from orph group by job_name),
g as (select count(rss_delta) n_deltas, coalesce(avg(rss_delta), 0.0) global_avg_delta,
  case when count(rss_delta) > 1 then stddev_samp(rss_delta) else 0.0 end global_stddev_delta
  from e where log_type = 'END'),
gt as (select *, global_avg_delta + 2 * global_stddev_delta outlier_threshold from g),
js0 as (select coalesce(oc.job_name, es.job_name) job_name, cast(coalesce(run_count, 0) as bigint) run_count,
  cast(coalesce(orphaned_count, 0) as bigint) orphaned_count, coalesce(avg_d, 0.0) avg_rss_delta,
  case when n_deltas > 0 then tot_d else 0.0 end total_rss_delta,
  case when n_deltas > 1 then sd_d else 0.0 end stddev_rss_delta, coalesce(avg_v, 0.0) avg_vms_delta,
  coalesce(avg_p, 0.0) avg_peak_rss, coalesce(max_p, 0.0) max_peak_rss,
  case when n_pts >= 2 then coalesce(slope, 0.0) * 3600 else 0.0 end rss_growth_rate_mb_per_hour,
  case when n_pts >= 2 then last_a - first_a else 0.0 end baseline_shift_mb
  from oc full outer join es on oc.job_name = es.job_name),
js1 as (select js0.*, run_count * avg_rss_delta cumulative_impact,
  case when avg_peak_rss > 0 then avg_peak_rss / LIMIT * 100 else 0.0 end headroom_consumed_percent,
  case when avg_peak_rss > 0 and rss_growth_rate_mb_per_hour > 0 and LIMIT - avg_peak_rss > 0
       then (LIMIT - avg_peak_rss) / rss_growth_rate_mb_per_hour end time_to_oom_hours,
  (gt.n_deltas > 0 and avg_rss_delta > gt.outlier_threshold) is_statistical_outlier
  from js0, gt),
js as (select js1.*, orphaned_count * 10000.0
  + case when rss_growth_rate_mb_per_hour > 1.0 then rss_growth_rate_mb_per_hour * 40 else 0.0 end
  + case when avg_rss_delta > 0.5 then avg_rss_delta * 20 else 0.0 end
  + case when baseline_shift_mb > 10.0 then baseline_shift_mb * 15 else 0.0 end
  + abs(avg_vms_delta) * 10 + cumulative_impact * 10
  + case when is_statistical_outlier then 5.0 else 0.0 end leak_score from js1),
top as (select row_number() over (order by leak_score desc, job_name) rank, * from js
  order by leak_score desc, job_name limit 10)
""".replace("LIMIT - ", LIMIT + " - ").replace("/ LIMIT", "/ " + LIMIT).replace("(LIMIT", "(" + LIMIT)


def _w(body: str) -> str:
    return "with " + F1_TYPED + body


R = "round({0}, 6) as {0}".format
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}".format

F1_TEXT = """
with t as (select event_id line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') ts_s, 'job_' || cast(user_id % 20 as varchar) job,
  event_type, round(value, 2) v,
  cast(event_id % 7 - 2 + case when user_id % 20 = 7 then 25 else 0 end as double) d,
  cast(event_id % 11 - 4 as double) vd, round((user_id % 20) * (event_id - event_id % 100) * 0.01, 2) g,
  cast(event_id % 90 as double) dur, cast(event_id % 100 as double) pct from events)
select line_no, case event_type
 when 'view' then printf('[%s] app [MEMORY_TRACK_START] job=''%s'' rss_mb=%.2f vms_mb=%.2f memory_percent=%.2f system_available_mb=%.2f',
   ts_s, job, v, round(v + 300, 2), pct, round(8000 - v, 2))
 when 'purchase' then printf('[%s] app [MEMORY_TRACK_END] job=''%s'' duration=%.2fs rss_before=%.2fMB rss_after=%.2fMB rss_delta=%s%.2fMB vms_delta=%s%.2fMB peak_rss=%.2fMB ',
   ts_s, job, dur, round(v + g, 2), round(v + g + d, 2), case when d >= 0 then '+' else '' end, d,
   case when vd >= 0 then '+' else '' end, vd, round(v + g + 50, 2))
 when 'click' then printf('[%s] app [MEMORY_MONITOR] job=''%s'' elapsed=%.2fs current_rss_mb=%.2f peak_rss_mb=%.2f current_vms_mb=%.2f system_available_mb=%.2f memory_percent=%.2f',
   ts_s, job, dur, v, round(v + g + 50, 2), round(v + 300, 2), round(8000 - v, 2), pct)
 when 'error' then printf('[%s] app [MEMORY_TRACK_FAILED] job=''%s'' error=''x''', ts_s, job)
 else printf('[%s] app heartbeat %d', ts_s, line_no) end line
from t
"""

METRICS = ("rss_mb", "vms_mb", "rss_before", "rss_after", "rss_delta", "vms_delta", "peak_rss",
           "current_rss_mb", "peak_rss_mb", "duration", "memory_percent", "system_available_mb", "elapsed")

ORACLE = {
    "log_render": _w("""select line_no, case log_type
  when 'START' then printf('[MEMORY_TRACK_START] job=''%s'' rss_mb=%.2f vms_mb=%.2f memory_percent=%.2f system_available_mb=%.2f',
    job_name, rss_mb, vms_mb, memory_percent, system_available_mb)
  when 'MONITOR' then printf('[MEMORY_MONITOR] job=''%s'' elapsed=%.1fs current_rss_mb=%.2f peak_rss_mb=%.2f current_vms_mb=%.2f system_available_mb=%.2f memory_percent=%.2f',
    job_name, elapsed, current_rss_mb, peak_rss_mb, current_rss_mb + 300, 8000 - current_rss_mb, memory_percent)
  else printf('[MEMORY_TRACK_END] job=''%s'' duration=%.2fs rss_before=%.2fMB rss_after=%.2fMB rss_delta=%+.2fMB vms_delta=%+.2fMB peak_rss=%.2fMB ',
    job_name, duration, rss_before, rss_after, rss_delta, vms_delta, peak_rss) end message from e"""),
    "memlog_lines": F1_TEXT,
    "memlog_parse": _w(f"select line_no, {TS('ts')}, log_type, job_name, "
                       + ", ".join(R(m) for m in METRICS) + " from e"),
    "ts_parse": _w(f"select line_no, {TS('ts')}, cast(year(ts) as integer) yr, cast(hour(ts) as integer) hr, "
                   "cast(second(ts) as integer) sec from e"),
    "entries_sorted": _w(f"select line_no, {TS('ts')}, log_type, job_name from e"),
    "start_end_pairs": _w(f"select line_no, job_name, {TS('end_ts')}, {TS('start_ts')} from pairs"),
    "orphaned_jobs": _w(f"select job_name, {TS('start_time')}, {R('rss_at_start')}, {R('vms_at_start')}, "
                        f"{R('memory_percent_at_start')}, {R('system_available_at_start')} from orph"),
    "job_run_counts": _w("select job_name, run_count, orphaned_count from js"),
    "job_rss_delta": _w(f"select job_name, {R('avg_rss_delta')}, {R('total_rss_delta')}, "
                        f"{R('stddev_rss_delta')} from js"),
    "job_vms_delta": _w(f"select job_name, {R('avg_vms_delta')} from js"),
    "job_peak_rss": _w(f"select job_name, {R('avg_peak_rss')}, {R('max_peak_rss')} from js"),
    "job_growth_rate": _w(f"select job_name, {R('rss_growth_rate_mb_per_hour')} from js"),
    "job_baseline_shift": _w(f"select job_name, {R('baseline_shift_mb')} from js"),
    "job_cumulative_impact": _w(f"select job_name, run_count, {R('cumulative_impact')} from js"),
    "job_headroom": _w(f"select job_name, {R('headroom_consumed_percent')} from js"),
    "job_time_to_oom": _w(f"select job_name, {R('time_to_oom_hours')} from js"),
    "global_delta_stats": _w(f"select n_deltas, {R('global_avg_delta')}, {R('global_stddev_delta')}, "
                             f"{R('outlier_threshold')} from gt"),
    "outlier_threshold_cross": _w(f"select job_name, {R('avg_rss_delta')}, {R('outlier_threshold')} "
                                  "from js0, gt"),
    "job_outliers": _w("select job_name, is_statistical_outlier from js"),
    "job_stats_full": _w("select job_name, run_count, orphaned_count, " + ", ".join(R(c) for c in (
        "avg_rss_delta", "total_rss_delta", "stddev_rss_delta", "avg_vms_delta", "avg_peak_rss", "max_peak_rss",
        "rss_growth_rate_mb_per_hour", "baseline_shift_mb", "cumulative_impact", "headroom_consumed_percent",
        "time_to_oom_hours")) + f", is_statistical_outlier, {R('leak_score')} from js"),
    "leak_scores": _w(f"select job_name, {R('leak_score')} from js"),
    "analysis_overview": _w(f"""select cast(count(*) as bigint) total_entries,
  (select count(*) from (select job_name from orph union select job_name from e where log_type = 'END')) total_jobs_tracked,
  strftime(arg_min(ts, line_no), '%Y-%m-%d %H:%M:%S') time_range_start,
  strftime(arg_max(ts, line_no), '%Y-%m-%d %H:%M:%S') time_range_end,
  round(case when count(*) filter (where log_type = 'END') > 0
    and coalesce(arg_min(rss_before, line_no) filter (where log_type = 'END'), 0) <> 0
    and coalesce(arg_max(rss_after, line_no) filter (where log_type = 'END'), 0) <> 0
    then arg_max(rss_after, line_no) filter (where log_type = 'END') - arg_min(rss_before, line_no) filter (where log_type = 'END')
    else 0.0 end, 6) overall_rss_growth,
  round(case when (epoch(arg_max(ts, line_no)) - epoch(arg_min(ts, line_no))) / 3600 > 0 then
    (case when count(*) filter (where log_type = 'END') > 0
    and coalesce(arg_min(rss_before, line_no) filter (where log_type = 'END'), 0) <> 0
    and coalesce(arg_max(rss_after, line_no) filter (where log_type = 'END'), 0) <> 0
    then arg_max(rss_after, line_no) filter (where log_type = 'END') - arg_min(rss_before, line_no) filter (where log_type = 'END')
    else 0.0 end) / ((epoch(arg_max(ts, line_no)) - epoch(arg_min(ts, line_no))) / 3600) else 0.0 end, 6)
    overall_growth_rate_mb_per_hour,
  round(arg_max(rss_after, line_no) filter (where log_type = 'END'), 6) current_rss_mb,
  (select round(global_avg_delta, 6) from gt) global_avg_delta,
  (select round(global_stddev_delta, 6) from gt) global_stddev_delta,
  {LIMIT} container_limit_mb,
  round(case when coalesce(arg_max(rss_after, line_no) filter (where log_type = 'END'), 0) <> 0
    then {LIMIT} - arg_max(rss_after, line_no) filter (where log_type = 'END') end, 6) available_headroom_mb,
  round(case when coalesce(arg_max(rss_after, line_no) filter (where log_type = 'END'), 0) <> 0
    then ({LIMIT} - arg_max(rss_after, line_no) filter (where log_type = 'END')) / {LIMIT} * 100 end, 6)
    headroom_percent
  from e"""),
    "top_culprits": _w(f"select cast(rank as integer) rank, job_name, {R('leak_score')}, orphaned_count, "
                       "run_count from top"),
    "leak_rank": _w(f"select cast(rank as integer) rank, job_name, {R('leak_score')} from top "
                    "where leak_score >= 1"),
    "negligible_score": _w("select job_name, leak_score < 1 hidden from js"),
    "leak_indicators": _w("""select job_name, concat_ws(', ',
  case when orphaned_count > 0 then 'ORPHANED_JOB' end, case when rss_growth_rate_mb_per_hour > 1.0 then 'GROWTH_RATE' end,
  case when avg_rss_delta > 0.5 then 'AVG_DELTA' end, case when baseline_shift_mb > 10 then 'BASELINE_SHIFT' end)
  indicators from js"""),
    "severity_label": _w("""select job_name, case when orphaned_count > 0 then 'CRITICAL - CAUSED CRASH'
  when leak_score > 50 then 'HIGH PRIORITY' else '' end severity from js"""),
    "time_to_oom_band": _w("""select job_name, case when time_to_oom_hours is null then null
  when time_to_oom_hours < 24 then printf('%.1f hours [CRITICAL]', time_to_oom_hours)
  when time_to_oom_hours < 168 then printf('%.1f days [WARNING]', time_to_oom_hours / 24)
  else printf('%.1f days', time_to_oom_hours / 24) end band from js"""),
    "last_monitor_before_crash": _w(f"""
, mon as (select m.*, (select max(s.ts) from e s where s.log_type = 'START' and s.job_name = m.job_name
    and (s.ts < m.ts or (s.ts = m.ts and s.line_no < m.line_no))) run_start from e m where m.log_type = 'MONITOR'),
lm as (select job_name, run_start, count(*) n, arg_max(ts, (ts, line_no)) lts, arg_max(elapsed, (ts, line_no)) el,
    arg_max(current_rss_mb, (ts, line_no)) cr, arg_max(peak_rss_mb, (ts, line_no)) pk,
    arg_max(memory_percent, (ts, line_no)) mp from mon where run_start is not null group by job_name, run_start)
select o.job_name, {TS('o.start_time').replace(' as o.start_time', ' as start_time')},
  cast(coalesce(lm.n, 0) as bigint) monitor_samples,
  strftime(lm.lts, '%Y-%m-%d %H:%M:%S') last_monitor_ts, round(lm.el, 6) elapsed, round(lm.cr, 6) current_rss_mb,
  round(lm.pk, 6) peak_rss_mb, round(lm.mp, 6) memory_percent
from orph o left join lm on o.job_name = lm.job_name and o.start_time = lm.run_start"""),
}
