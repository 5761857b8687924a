"""DuckDB oracle SQL for the conversion-log queries: typed events built from
``documents`` directly, then the fold as brute-force correlated subqueries."""

F2_TYPED = """
d as (select doc_id, doc_id % 50 log_id, case when doc_id % 3 = 0 then 'excel' when doc_id % 3 = 1 then 'powerpoint'
  else 'word' end ty, n_chars sz_c, (n_chars + 1) // 2 pdf_c from documents),
n as (select *, ty || '_input_' || cast(doc_id as varchar) || case ty when 'excel' then '.xlsx'
  when 'powerpoint' then '.pptx' else '.docx' end fn from d),
x as (select n.*, k from n, range(6) r(k) where not (k = 3 and doc_id % 4 <> 0) and not (k = 4 and doc_id % 5 = 0)
  and not (k = 5 and (doc_id % 5 = 0 or doc_id % 7 = 0))),
ev as (select cast(log_id as varchar) log_id, doc_id * 10 + k line_no, '2026-01-08 10:00:0' || cast(k as varchar) "timestamp",
  case k when 0 then 'ENTRY' when 1 then 'ATTEMPT' when 2 then 'LINK_SCAN' when 3 then 'ATTEMPT' when 4 then 'SUCCESS'
    else 'CONVERTED' end event_type,
  case when k in (1, 3, 5) then fn when k = 2 then case doc_id % 9 when 0 then 'other' when 1 then replace(fn, ty || '_', '')
    when 2 then cast(doc_id % 10 as varchar) || '.' || split_part(fn, '.', 2) else fn end end filename,
  case when k in (0, 1, 3, 4) then ty end file_type,
  case k when 1 then 1 when 3 then 2 end attempt,
  case when k in (1, 3) then sz_c / 100.0 end input_size,
  case when k = 2 then cast(doc_id % 4 as integer) end links_found,
  case when k = 2 then case doc_id % 4 when 0 then []::varchar[] when 1 then ['ole'] else ['ole', 'chart'] end end link_types,
  case when k in (4, 5) then pdf_c / 100.0 end pdf_size,
  case when k = 5 then cast(doc_id % 60 as double) end conversion_time
  from x),
cur as (select e.*, (select a.filename from ev a where a.log_id = e.log_id and a.event_type = 'ATTEMPT'
  and a.line_no <= e.line_no order by a.line_no desc limit 1) current_file from ev e),
convs as (select log_id, filename, min(line_no) created, arg_min(file_type, line_no) file_type,
  arg_min("timestamp", line_no) "timestamp", arg_max(attempt, line_no) attempt_number,
  arg_max(input_size, line_no) filter (where input_size is not null) input_size_mb
  from ev where event_type = 'ATTEMPT' group by log_id, filename),
sm as (select s.log_id, s.line_no, s.filename scan_name, s.links_found, s.link_types, s.current_file,
  (select c.filename from convs c where c.log_id = s.log_id and c.created < s.line_no
    and (contains(c.filename, s.filename) or contains(s.filename, c.filename)) order by c.created limit 1) matched
  from cur s where event_type = 'LINK_SCAN'),
st as (select *, coalesce(matched, current_file) target from sm),
cm as (select e.log_id, e.line_no, e.filename, e.pdf_size, e.conversion_time,
  case when exists (select 1 from convs c where c.log_id = e.log_id and c.filename = e.filename and c.created < e.line_no)
  then e.filename end matched from ev e where event_type = 'CONVERTED'),
scan_last as (select log_id, target filename, arg_max(links_found, line_no) links_found,
  arg_max(link_types, line_no) link_types from st where target is not null group by log_id, target),
done as (select log_id, filename, count(*) n_done, arg_max(pdf_size, line_no) pdf_size_mb,
  arg_max(conversion_time, line_no) filter (where is_conv) conversion_time_seconds from (
  select log_id, current_file filename, line_no, pdf_size, null::double conversion_time, false is_conv from cur
    where event_type = 'SUCCESS' and current_file is not null
  union all select log_id, matched, line_no, pdf_size, conversion_time, true from cm where matched is not null)
  group by log_id, filename),
rec as (select c.log_id, c.filename, c.file_type, coalesce(s.links_found > 0, false) has_links,
  coalesce(s.links_found, 0) links_found, coalesce(s.link_types, []::varchar[]) link_types,
  coalesce(dn.n_done > 0, false) conversion_successful, c.input_size_mb, dn.pdf_size_mb, dn.conversion_time_seconds,
  c.attempt_number, 2 max_retries, coalesce(c."timestamp", '') "timestamp", c.created
  from convs c left join scan_last s on c.log_id = s.log_id and c.filename = s.filename
  left join done dn on c.log_id = dn.log_id and c.filename = dn.filename)
"""


def _w(body):
    return "with " + F2_TYPED + body


REC = """select log_id, filename, file_type, has_links, links_found, array_to_string(link_types, '|') link_types,
  conversion_successful, round(input_size_mb, 6) input_size_mb, round(pdf_size_mb, 6) pdf_size_mb,
  round(conversion_time_seconds, 6) conversion_time_seconds, attempt_number, max_retries, "timestamp" from rec"""

F2_TEXT = """
with d as (select doc_id, doc_id % 50 log_id, case when doc_id % 3 = 0 then 'excel' when doc_id % 3 = 1 then 'powerpoint'
  else 'word' end ty, n_chars sz_c, (n_chars + 1) // 2 pdf_c from documents),
n as (select *, ty || '_input_' || cast(doc_id as varchar) || case ty when 'excel' then '.xlsx'
  when 'powerpoint' then '.pptx' else '.docx' end fn, printf('%d.%02d', sz_c // 100, sz_c % 100) sz,
  printf('%d.%02d', pdf_c // 100, pdf_c % 100) pdf from d),
x as (select n.*, k from n, range(6) r(k) where not (k = 3 and doc_id % 4 <> 0) and not (k = 4 and doc_id % 5 = 0)
  and not (k = 5 and (doc_id % 5 = 0 or doc_id % 7 = 0)))
select cast(log_id as varchar) log_id, doc_id * 10 + k line_no, '[2026-01-08 10:00:0' || cast(k as varchar) || '] ' ||
  case k when 0 then '[ENTRY] convert_office_to_pdf called: type=' || ty || ', size=' || sz || 'MB, max_retries=2'
  when 1 then '[Attempt 1/2] Converting ' || fn || ' (' || sz || 'MB)...'
  when 2 then '[LINK_SCAN] file=''' || case doc_id % 9 when 0 then 'other' when 1 then replace(fn, ty || '_', '')
    when 2 then cast(doc_id % 10 as varchar) || '.' || split_part(fn, '.', 2) else fn end
    || ''' external_links_found=' || cast(doc_id % 4 as varchar) || ' link_types=['
    || case doc_id % 4 when 0 then '' when 1 then '''ole''' else '''ole'', ''chart''' end || ']'
  when 3 then '[Attempt 2/2] Converting ' || fn || ' (' || sz || 'MB)...'
  when 4 then '[SUCCESS] ' || ty || ' conversion completed, PDF size: ' || pdf || 'MB'
  else 'Converted ' || fn || ' to PDF (' || pdf || 'MB) in ' || cast(doc_id % 60 as varchar) || '.00s' end line
from x"""

ORACLE = {
    "convlog_lines": F2_TEXT,
    "convlog_parse": _w("""select log_id, line_no, "timestamp", event_type, filename, file_type, attempt,
  round(input_size, 6) input_size, links_found, array_to_string(link_types, '|') link_types, round(pdf_size, 6) pdf_size,
  round(conversion_time, 6) conversion_time from ev"""),
    "link_types_split": _w("""select log_id, line_no, cast(len(link_types) as integer) n_types,
  array_to_string(link_types, '|') link_types from ev where event_type = 'LINK_SCAN'"""),
    "conv_current_file": _w("select log_id, line_no, event_type, current_file from cur"),
    "conv_link_match": _w("select log_id, line_no, scan_name, matched, target from st"),
    "conv_completed_match": _w("select log_id, line_no, filename, matched from cm"),
    "conv_records": _w(REC),
    "conv_summary": _w("""select count(*) total, count(*) filter (where conversion_successful) successful,
  count(*) filter (where has_links) with_links, count(*) filter (where has_links and conversion_successful) successful_with_links,
  round(case when count(*) > 0 then 100.0 * count(*) filter (where conversion_successful) / count(*) end, 6) success_pct,
  round(case when count(*) filter (where has_links) > 0 then 100.0 * count(*) filter (where has_links and conversion_successful)
    / count(*) filter (where has_links) end, 6) links_success_pct from rec"""),
    "conv_by_type": _w("""select file_type, count(*) total, count(*) filter (where conversion_successful) successful
  from rec where file_type in ('excel', 'powerpoint') group by file_type"""),
    "conv_detail_sorted": _w(REC),
    "docs_with_links": _w(REC + " where has_links"),
    "conv_report_truncate": _w("""select log_id, filename,
  case when length(filename) > 40 then substr(filename, 1, 37) || '...' else filename end filename_cell,
  case when length(lt) > 15 then substr(lt, 1, 12) || '...' else lt end link_types_cell
  from (select *, case when len(link_types) > 0 then array_to_string(link_types, ', ') else '-' end lt from rec)"""),
}
