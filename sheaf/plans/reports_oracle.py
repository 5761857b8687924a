"""DuckDB oracle SQL for report lines that are exactly defined (K1, K3) and T5."""

from sheaf.plans.content_oracle import ORACLE as CONTENT
from sheaf.plans.content_oracle import _html_sql, unescaped
from sheaf.plans.convlog_oracle import F2_TYPED
from sheaf.plans.documents_oracle import F5
from sheaf.plans.memlog_oracle import F1_TYPED
from sheaf.plans.packages_oracle import F3
from sheaf.plans.samples_oracle import F4, OUTCOMES

RULE = "=" * 100

ORACLE = {
    "leak_csv": "with " + F1_TYPED + """select cast(0 as bigint) rank, 'job_name,orphaned_count,run_count,leak_score,growth_rate_mb_per_hour,avg_rss_delta_mb,'
  || 'total_rss_delta_mb,baseline_shift_mb,cumulative_impact_mb,avg_vms_delta_mb,avg_peak_rss_mb,max_peak_rss_mb,time_to_oom_hours,'
  || 'headroom_consumed_pct,is_outlier' line
  union all select rank, printf('"%s",%d,%d,%.2f,%.2f,%.2f,%.2f,%.2f,%.2f,%.2f,%.2f,%.2f,', job_name, orphaned_count, run_count,
  leak_score, rss_growth_rate_mb_per_hour, avg_rss_delta, total_rss_delta, baseline_shift_mb, cumulative_impact, avg_vms_delta,
  avg_peak_rss, max_peak_rss) || case when coalesce(time_to_oom_hours, 0) <> 0 then printf('%.6f', time_to_oom_hours) else '' end
  || ',' || case when headroom_consumed_percent > 0 then printf('%.2f', headroom_consumed_percent) else '' end || ','
  || case when is_statistical_outlier then '1' else '0' end from top""",
    "conv_csv": "with " + F2_TYPED + """select distinct log_id, '' filename, cast(0 as integer) ord,
  'filename,file_type,has_links,links_found,link_types,conversion_successful,input_size_mb,pdf_size_mb,conversion_time_seconds' line from rec
  union all select log_id, filename, cast(1 as integer), '"' || filename || '",' || coalesce(file_type, 'None') || ',' ||
  case when has_links then 'True' else 'False' end || ',' || cast(links_found as varchar) || ',"' || array_to_string(link_types, '|')
  || '",' || case when conversion_successful then 'True' else 'False' end || ',' || coalesce(cast(input_size_mb as varchar), '') || ',' ||
  case when coalesce(pdf_size_mb, 0) <> 0 then cast(pdf_size_mb as varchar) else '' end || ',' ||
  case when coalesce(conversion_time_seconds, 0) <> 0 then cast(conversion_time_seconds as varchar) else '' end line from rec""",
    "stale_runs": "with " + F1_TYPED + """select job_name, strftime(start_time, '%Y-%m-%d %H:%M:%S') start_time,
  round(epoch(timestamp '2024-01-31 00:00:00') - epoch(start_time), 6) age_seconds from orph
  where epoch(timestamp '2024-01-31 00:00:00') - epoch(start_time) > 259200""",
}

_PROFILED = "with " + F4 + f""", {OUTCOMES},
bs as (select st.*, error, (select min(seq) from s where s.run_id = st.run_id and s.epoch_s = st.b_t) b_seq from st left join oc using (run_id))"""

ORACLE["profiler_report_lines"] = _PROFILED + f""",
jb as (select *, row_number() over (order by b_t, b_seq) idx from bs),
cu as (select *, row_number() over (order by -rss_delta_mb, run_id) idx2 from bs where rss_delta_mb > 50 or p_rss > 500)
select cast(section as integer) section, cast(k as bigint) ord, line from (
  select 0 section, 0 k, '{"=" * 80}' line union all select 0, 1, 'MEMORY PROFILING REPORT' union all select 0, 2, '{"=" * 80}'
  union all select 0, 3, '' union all select 0, 4, 'Job-by-Job Memory Usage:' union all select 0, 5, '{"-" * 80}'
  union all select 1, idx * 100, printf('%d. %s run_%d | Duration: %.2fs | RSS Delta: %+.2fMB | VMS Delta: %+.2fMB | Peak RSS: %.2fMB',
    idx, case when error is null then '[SUCCESS]' else '[FAILED]' end, run_id, duration_seconds, rss_delta_mb, vms_delta_mb, p_rss) from jb
  union all select 1, idx * 100 + 1, '   Error: ' || error from jb where error is not null
  union all select 2, 0, '' union all select 2, 1, '{"-" * 80}' union all select 2, 2, 'SUMMARY:'
  union all select 2, 3, printf('  Total jobs tracked: %d', (select count(*) from bs))
  union all select 2, 4, printf('  Total RSS delta: %+.2fMB', (select sum(rss_delta_mb) from bs))
  union all select 2, 5, (select printf('  Largest RSS increase: run_%d (%+.2fMB)', arg_max(run_id, (rss_delta_mb, -b_t, -b_seq)), max(rss_delta_mb)) from bs)
  union all select 2, 6, (select printf('  Highest peak RSS: run_%d (%.2fMB)', arg_max(run_id, (p_rss, -b_t, -b_seq)), max(p_rss)) from bs)
  union all select 2, 7, '' union all select 2, 8, 'POTENTIAL OOM CULPRITS (RSS delta > 50MB or RSS > 500MB):'
  union all select 2, 9, '  No obvious culprits found.' where (select count(*) from cu) = 0
  union all select 3, idx2 * 100, printf('  [WARNING] run_%d:', run_id) from cu
  union all select 3, idx2 * 100 + 1, printf('      RSS Delta: %+.2fMB', rss_delta_mb) from cu
  union all select 3, idx2 * 100 + 2, printf('      Peak RSS: %.2fMB', p_rss) from cu
  union all select 4, 0, '' union all select 4, 1, '{"=" * 80}')"""

ORACLE["profiler_json"] = _PROFILED + """ select 'run_' || cast(run_id as varchar) "name", 'name,duration,rss_delta_mb,peak_rss_mb,success' keys,
  round(duration_seconds, 6) duration, round(rss_delta_mb, 6) rss_delta_mb, round(p_rss, 6) peak_rss_mb, error is null success from bs"""

ORACLE["doc_metadata_json"] = "with " + F5 + """ select file_path, 'processing_date,statistics,output_location' keys, '2026-01-08T10:00:00' processing_date,
  filename statistics_filename, format statistics_format, success statistics_success, round(file_size_mb, 6) statistics_file_size_mb,
  cast(tables_found as bigint) statistics_tables_found, cast(tables_exported as bigint) statistics_tables_exported,
  cast(images_extracted as bigint) statistics_images_extracted, cast(page_images_extracted as bigint) statistics_page_images_extracted,
  round(processing_time_seconds, 6) statistics_processing_time_seconds, error statistics_error, 'out/' || file_path output_location
  from st where success"""

ORACLE["batch_summary_json"] = "with " + F5 + """, b as (select coalesce(format, 'None') format, count(*) n, count(*) filter (where success) ok from st group by 1)
select printf('{"total_files":%d,"successful":%d,"failed":%d,"total_tables_extracted":%d,"total_images_extracted":%d,"total_page_images_extracted":%d,'
  || '"total_processing_time_seconds":T,"output_directory":"out","format_breakdown":{', count(*), count(*) filter (where success),
  count(*) filter (where not success), cast(sum(tables_found) as bigint), cast(sum(images_extracted) as bigint), cast(sum(page_images_extracted) as bigint))
  || (select string_agg(printf('"%s":{"count":%d,"success":%d}', format, n, ok), ',' order by format) from b) || '}}' json from st"""

ORACLE["markdown_sink"] = "with " + F3 + f""", dk as (select path, string_agg(printf('## Slide %d', member_ix) || chr(10) || chr(10)
  || {unescaped("regexp_extract(content, '(?s)<a:t>(.*?)</a:t>', 1)")}, chr(10) || chr(10) order by member_ix) md
  from m where member_ix % 5 = 0 group by path)
select 'pages/' || cast(page_id as varchar) || '.html' doc_key, md5({_html_sql("html")}) md5 from pages
union all select path, md5(md) from dk"""

ORACLE["output_layout"] = f"""with x as (select 'csv' fmt, table_id, line from ({CONTENT["table_to_csv"]})
  union all select 'json', table_id, line from ({CONTENT["table_to_json"]}))
select 'tables' kind, fmt, table_id, line from x"""

_HEAD = "\n".join(["", "DETAILED CONVERSION RESULTS", "-" * 120,
                   f"{'Filename':<40} {'Type':<12} {'Links':<6} {'Link Types':<15} {'Status':<10} {'Input Size':<12} {'PDF Size':<12}",
                   "-" * 120]).replace("'", "''")

ORACLE["conv_report_lines"] = "with " + F2_TYPED + f""",
smr as (select count(*) total, count(*) filter (where conversion_successful) successful, count(*) filter (where has_links) with_links,
  count(*) filter (where has_links and conversion_successful) swl from rec),
rows as (select *, case when len(link_types) > 0 then array_to_string(link_types, ', ') else '-' end lt,
  row_number() over (order by not has_links, filename, log_id) idx from rec)
select 0 section, cast(k as bigint) ord, line from (
  select 0 k, '{RULE}' line union all select 1, 'DOCUMENT CONVERSION LOG ANALYSIS REPORT' union all select 2, '{RULE}'
  union all select 3, '' union all select 4, 'SUMMARY' union all select 5, '{"-" * 50}'
  union all select 6, printf('Total documents processed: %d', total) from smr
  union all select 7, case when total > 0 then printf('Successful conversions: %d (%.1f%%)', successful, 100.0 * successful / total)
    else 'No documents' end from smr
  union all select 8, printf('Documents with links: %d', with_links) from smr
  union all select 9, printf('Documents with links - successful: %d', swl) from smr
  union all select 10, case when with_links > 0 then printf('Success rate for docs with links: %.1f%%', 100.0 * swl / with_links) end from smr
  union all select 11, '' union all select 12, 'BY FILE TYPE' union all select 13, '{"-" * 50}') where line is not null
union all select 1, case when file_type = 'excel' then 0 else 1 end, printf('%s: %d total, %d successful',
  case when file_type = 'excel' then 'Excel' else 'PowerPoint' end, count(*), count(*) filter (where conversion_successful))
  from rec where file_type in ('excel', 'powerpoint') group by file_type
union all select 2, 0, '{_HEAD}'
union all select 3, idx, printf('%-40s %-12s %-6s %-15s %-10s %-12s %-12s',
  case when length(filename) > 40 then substr(filename, 1, 37) || '...' else filename end, coalesce(file_type, 'None'),
  case when has_links then cast(links_found as varchar) else '0' end,
  case when length(lt) > 15 then substr(lt, 1, 12) || '...' else lt end,
  case when conversion_successful then 'SUCCESS' else 'FAILED' end,
  case when input_size_mb is not null then printf('%.2fMB', input_size_mb) else '-' end,
  case when coalesce(pdf_size_mb, 0) <> 0 then printf('%.2fMB', pdf_size_mb) else '-' end) from rows
union all select 4, 0, '' union all select 4, 1, '{RULE}'
union all select 4, k, line from smr, (values (2, ''), (3, 'DOCUMENTS WITH LINKS - DETAILED'), (4, '{"-" * 100}')) v(k, line) where with_links > 0
union all select 5, idx * 100 + k, line from (select *, row_number() over (order by log_id, created) idx from rec where has_links) r,
  lateral (select * from (values (0, 'File: ' || filename), (1, '  Type: ' || coalesce(file_type, 'None')), (2, printf('  Links found: %d', links_found)),
  (3, '  Link types: ' || case when len(link_types) > 0 then '[''' || array_to_string(link_types, ''', ''') || ''']' else '[]' end),
  (4, '  Conversion status: ' || case when conversion_successful then 'SUCCESS' else 'FAILED' end),
  (5, '  Input size: ' || cast(input_size_mb as varchar) || 'MB'),
  (6, case when coalesce(pdf_size_mb, 0) <> 0 then '  PDF size: ' || cast(pdf_size_mb as varchar) || 'MB' end),
  (7, case when coalesce(conversion_time_seconds, 0) <> 0 then '  Conversion time: ' || cast(conversion_time_seconds as varchar) || 's' end), (8, '')) v(k, line))
  where line is not null"""

_DASH = "─" * 95
_LIM = "cast(2048.0 as double)"


ORACLE["leak_report_lines"] = "with " + F1_TYPED + f""",
ovr as (select count(*) n, arg_min(ts, line_no) t0, arg_max(ts, line_no) t1,
  count(*) filter (where log_type = 'END') n_end,
  arg_min(rss_before, line_no) filter (where log_type = 'END') fr, arg_max(rss_after, line_no) filter (where log_type = 'END') lr from e),
ov as (select *, case when n_end > 0 and coalesce(fr, 0) <> 0 and coalesce(lr, 0) <> 0 then lr - fr else 0.0 end growth,
  (epoch(t1) - epoch(t0)) / 3600 hrs from ovr),
orn as (select *, row_number() over (order by start_time, job_name) idx from orph),
ind as (select *, concat_ws(', ', case when orphaned_count > 0 then 'ORPHANED_JOB' end,
  case when rss_growth_rate_mb_per_hour > 1.0 then 'GROWTH_RATE' end, case when avg_rss_delta > 0.5 then 'AVG_DELTA' end,
  case when baseline_shift_mb > 10 then 'BASELINE_SHIFT' end) inds from top where leak_score >= 1),
lines as (
  select 0 section, 0 k, '{RULE}' line union all select 0, 1, 'MEMORY LEAK ANALYSIS REPORT' union all select 0, 2, '{RULE}'
  union all select 0, 3, '' union all select 0, 4, 'OVERVIEW:'
  union all select 0, 5, printf('  Log entries analyzed: %d', n) from ov
  union all select 0, 6, printf('  Unique jobs tracked: %d', (select count(*) from (select job_name from orph union select job_name from e where log_type = 'END'))) from ov
  union all select 0, 7, printf('  Time range: %s to %s', cast(t0 as varchar), cast(t1 as varchar)) from ov
  union all select 0, 8, printf('  Duration: %.1f minutes', (epoch(t1) - epoch(t0)) / 60) from ov
  union all select 0, 9, ''
  union all select 0, 10, printf('  Overall RSS growth: %+.2f MB', growth) from ov
  union all select 0, 11, printf('  Overall growth rate: %+.2f MB/hour', case when hrs > 0 then growth / hrs else 0.0 end) from ov
  union all select 0, 12, ''
  union all select 1, 0, 'CONTAINER CONTEXT:'
  union all select 1, 1, printf('  Container memory limit: %.2f MB (%.2f GiB)', {_LIM}, {_LIM} / 1024)
  union all select 1, 2, case when coalesce(lr, 0) <> 0 and n_end > 0 then printf('  Current RSS usage: %.2f MB (%.1f%% of limit)', lr, lr / {_LIM} * 100)
    else '  Current RSS usage: N/A' end from ov
  union all select 1, 3, case when coalesce(lr, 0) <> 0 and n_end > 0 and {_LIM} - lr <> 0
    then printf('  Available headroom: %.2f MB (%.1f%%)', {_LIM} - lr, ({_LIM} - lr) / {_LIM} * 100) else '  Available headroom: N/A' end from ov
  union all select 1, 4, ''
  union all select 2, 0, '{RULE}'
  union all select 2, 1, case when (select count(*) from orph) > 0 then '!!! CRITICAL: JOBS THAT STARTED BUT NEVER COMPLETED !!!'
    else 'ORPHANED JOBS CHECK: PASSED' end
  union all select 2, 2, '{RULE}' union all select 2, 3, ''
  union all select 2, 4, case when (select count(*) from orph) > 0 then 'These jobs are PRIMARY OOM SUSPECTS - they started but have no completion log.'
    else 'All jobs that started also completed successfully.' end
  union all select 2, 5, case when (select count(*) from orph) > 0 then 'This typically indicates the container was killed (OOM) during job execution.'
    else 'No evidence of container crash during job execution in this log sample.' end
  union all select 2, 6, ''
  union all select 4, k, x from (values (0, 'RECOMMENDATION: Investigate the jobs listed above. They are the most likely'),
    (1, '                culprits for OOM issues. Check what these jobs do and why'), (2, '                they might consume excessive memory.'),
    (3, '')) v(k, x) where (select count(*) from orph) > 0
  union all select 4, 4, '' union all select 4, 5, '{RULE}' union all select 4, 6, 'TOP MEMORY LEAK CULPRITS (ranked by leak score)'
  union all select 4, 7, '{RULE}' union all select 4, 8, '' union all select 4, 9, '  No culprits identified.' where (select count(*) from top) = 0
  union all select 7, 0, '{RULE}' union all select 7, 1, 'GLOBAL STATISTICS' union all select 7, 2, '{RULE}' union all select 7, 3, ''
  union all select 7, 4, printf('  Global average RSS delta: %.2f MB', global_avg_delta) from gt
  union all select 7, 5, printf('  Global standard deviation: %.2f MB', global_stddev_delta) from gt
  union all select 7, 6, printf('  Outlier threshold (mean + 2*stddev): %.2f MB', outlier_threshold) from gt
  union all select 7, 7, '')
select section, cast(k as bigint) ord, line from lines
union all select 3, idx * 100 + k, line from orn, lateral (select * from (values
  (0, printf('%d. %s', idx, job_name)), (1, '   {_DASH}'),
  (2, '   [STATUS]: JOB STARTED BUT NEVER FINISHED - LIKELY CAUSED CONTAINER CRASH'),
  (3, printf('   Start Time: %s', cast(start_time as varchar))), (4, printf('   RSS at Start: %.2f MB', rss_at_start)),
  (5, printf('   VMS at Start: %.2f MB', vms_at_start)), (6, printf('   Memory %% at Start: %.2f%%', memory_percent_at_start)),
  (7, printf('   System Available at Start: %.2f MB', system_available_at_start)), (8, '')) v(k, line))
union all select 5, rank * 100 + k, line from ind, lateral (select * from (values
  (0, printf('%d. %s', rank, job_name)), (1, '   {_DASH}'),
  (2, printf('   Leak Score: %.2f %s %s', leak_score, case when orphaned_count > 0 then 'CRITICAL - CAUSED CRASH'
     when leak_score > 50 then 'HIGH PRIORITY' else '' end, case when inds <> '' then '[' || inds || ']' else '' end)),
  (3, printf('   Completed Runs: %d', run_count)),
  (4, case when orphaned_count > 0 then printf('   Orphaned Runs: %d [CRITICAL - Job did not complete]', orphaned_count) end),
  (5, ''), (6, '   RSS Metrics:'),
  (7, printf('     • Growth Rate: %+.2f MB/hour %s', rss_growth_rate_mb_per_hour, case when rss_growth_rate_mb_per_hour > 1.0 then '[LEAK]' else '[OK]' end)),
  (8, printf('     • Avg Delta per Run: %+.2f MB %s', avg_rss_delta, case when avg_rss_delta > 0.5 then '[LEAK]' else '[OK]' end)),
  (9, printf('     • Total Delta: %+.2f MB', total_rss_delta)),
  (10, printf('     • Baseline Shift: %+.2f MB %s', baseline_shift_mb, case when baseline_shift_mb > 10 then '[LEAK]' else '[OK]' end)),
  (11, printf('     • Cumulative Impact: %.2f MB', cumulative_impact)), (12, ''), (13, '   Peak RSS:'),
  (14, printf('     • Average: %.2f MB', avg_peak_rss)), (15, printf('     • Maximum: %.2f MB', max_peak_rss)),
  (16, case when headroom_consumed_percent > 0 then printf('     • Headroom Consumed: %.1f%% of container limit', headroom_consumed_percent) end),
  (17, case when time_to_oom_hours is not null then '     • Predicted Time to OOM: ' || case when time_to_oom_hours < 24
     then printf('%.1f hours [CRITICAL]', time_to_oom_hours) when time_to_oom_hours < 168 then printf('%.1f days [WARNING]', time_to_oom_hours / 24)
     else printf('%.1f days', time_to_oom_hours / 24) end end),
  (18, ''), (19, '   VMS Metrics:'), (20, printf('     • Avg VMS Delta: %+.2f MB', avg_vms_delta)), (21, ''), (22, '   Statistical:'),
  (23, printf('     • Outlier: %s', case when is_statistical_outlier then 'YES [WARNING]' else 'No' end)),
  (24, printf('     • StdDev: %.2f MB', stddev_rss_delta)), (25, '')) v(k, line)) where line is not null"""
