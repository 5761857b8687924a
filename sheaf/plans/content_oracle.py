"""DuckDB oracle SQL for table-export, text and task queries."""

import re as _re

from sheaf.functions.text import HTML_RULES as _RULES
from sheaf.plans.memlog_oracle import F1_TYPED, ORACLE as MEMLOG
from sheaf.plans.packages_oracle import F3


def _html_sql(col: str) -> str:
    body = col
    for p, r in _RULES:
        r = _re.sub(r"\$(\d)", r"\\\1", r)
        pe = p.replace("'", "''")
        re_ = "'" + r.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        body = f"regexp_replace({body}, '{pe}', {re_}, 'g')"
    return f"trim({body})"


def unescaped(col: str) -> str:
    """The named entities of XML, the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")):
        col = f"replace({col}, '{entity}', '{char}')"
    return col


F6 = """
p as (select p_brand, p_partkey, p_name, p_retailprice, p_partkey rn from part),
c as (select p_brand table_id, cast(rn as bigint) row_ix, cast(col_ix as integer) col_ix,
  case col_ix when 0 then 'key' when 1 then 'name' else 'price' end header,
  case when col_ix = 0 then cast(p_partkey as varchar) when col_ix = 1 then case p_partkey % 7 when 0 then '' when 1 then '' else p_name end
    when p_partkey % 7 = 2 then '' else cast(cast(p_retailprice as decimal(14,2)) as varchar) end cell
  from p, range(3) t(col_ix)),
h as (select table_id, list(header order by col_ix) headers from (select distinct table_id, col_ix, header from c) group by table_id),
rw as (select table_id, row_ix, list(cell order by col_ix) cells from c group by table_id, row_ix),
md as (select table_id, count(distinct row_ix) num_rows, count(distinct col_ix) num_columns from c group by table_id)
"""


def _w(body):
    return "with " + F6 + body


CSVF = """case when regexp_matches(x, '[,"\\r\\n]') then '"' || replace(x, '"', '""') || '"' else x end"""
HTMLE = "replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"

F8 = """
te as (select user_id task_id, ts event_ts, event_id seq, case event_type when 'purchase' then 'success'
  when 'error' then 'failure' when 'signup' then 'pending' else 'started' end task_status, value * 0.002 progress from events),
ls as (select task_id, coalesce(arg_min(task_status, (event_ts, seq)) filter (where task_status in ('success', 'failure')),
  arg_max(task_status, (event_ts, seq))) task_status,
  case when count(*) filter (where task_status in ('success', 'failure')) > 0
    then arg_min(progress, (event_ts, seq)) filter (where task_status in ('success', 'failure'))
    else arg_max(progress, (event_ts, seq)) end progress,
  case when count(*) filter (where task_status in ('success', 'failure')) > 0
    then min(event_ts) filter (where task_status in ('success', 'failure')) else max(event_ts) end status_ts,
  count(*) n_events from te group by task_id)
"""

ORACLE = {
    "table_metadata": _w("""select md.table_id, num_rows, num_columns, array_to_string(headers, '|') headers, true has_headers,
  num_rows * num_columns total_cells, num_rows grid_rows, num_columns grid_cols, page_number, bbox from md join h using (table_id)
  join (select p_brand table_id, cast(arg_min(p_size, p_partkey) as integer) page_number,
    cast(cast(arg_min(p_size, p_partkey) as double) as varchar) || '|0.5|' || cast(cast(arg_min(p_size, p_partkey) + 10 as double) as varchar) || '|20.25' bbox
    from part group by p_brand) using (table_id)"""),
    "headers_preview": _w("""select table_id, array_to_string(headers[1:5], ', ') || case when len(headers) > 5 then '...' else '' end
  headers_preview from h"""),
    "table_to_csv": _w(f"""select table_id, cast(0 as bigint) line_ix, array_to_string(list_transform(headers, lambda x: {CSVF}), ',') line from h
  union all select table_id, row_ix + 1, array_to_string(list_transform(cells, lambda x: {CSVF}), ',') from rw"""),
    "table_to_markdown": _w("""select table_id, cast(0 as bigint) line_ix, '| ' || array_to_string(list_transform(headers, lambda x: replace(x, '|', '\\|')), ' | ')
  || ' |' || chr(10) || '|' || array_to_string(list_transform(headers, lambda x: ' --- '), '|') || '|' line from h
  union all select table_id, row_ix + 1, '| ' || array_to_string(list_transform(cells, lambda x: replace(x, '|', '\\|')), ' | ') || ' |' from rw"""),
    "table_to_json": _w("""select rw.table_id, row_ix + 1 line_ix, '{' || array_to_string(list_transform(list_zip(headers, cells),
  lambda z: to_json(case when z[1] = 'price' then 'name_2' else z[1] end) || ':' || to_json(z[2])), ',') || '}' line from rw join h using (table_id)"""),
    "table_to_html": _w(f"""select table_id, cast(0 as bigint) line_ix, '<table>' || chr(10) || '<tr>' ||
  array_to_string(list_transform(headers, lambda x: '<th>' || {HTMLE} || '</th>'), '') || '</tr>' line from h
  union all select table_id, row_ix + 1, '<tr>' || array_to_string(list_transform(cells, lambda x: '<td>' || {HTMLE} || '</td>'), '') || '</tr>' from rw
  union all select table_id, cast(4611686018427387904 as bigint), '</table>' from h"""),
    "html_to_markdown": f"select page_id, md5({_html_sql('html')}) md5, cast(length({_html_sql('html')}) as integer) n_chars from pages",
    "doc_chunk": """select doc_id, cast(chunk_ix as integer) chunk_ix, cast(start as integer) start,
  cast(length(substring(text, start, 1000)) as integer) n_chars, md5(substring(text, start, 1000)) md5 from (
  select doc_id, text, s.start, row_number() over (partition by doc_id order by s.start) - 1 chunk_ix
  from documents, unnest(case when length(text) > 0 then generate_series(1, greatest(length(text) - 100, 1), 900) else [] end) s(start))""",
    "task_status_latest": "with " + F8 + """select task_id, task_status, round(progress, 6) progress,
  strftime(status_ts, '%Y-%m-%d %H:%M:%S') status_ts, n_events from ls""",
    "task_results": "with " + F8 + """select ls.task_id, task_status, d.n_chars result_chars,
  task_status = 'success' and d.n_chars is not null has_result from ls left join documents d on d.doc_id = ls.task_id
  where task_status in ('success', 'failure')""",
}

_RESPONSES = """with r as (select doc_id, doc_id % 11 = 5 cut, doc_id % 7 = 0 failed, n_chars / 100.0 secs,
  (['json', 'markdown', 'html', 'text', 'JSON'])[doc_id % 5 + 1] fmt from documents)"""

ORACLE["responses_scan"] = _RESPONSES + """ select 'responses/' || cast(doc_id as varchar) || '.json' source, not cut valid,
  case when not cut then case when failed then 'failure' else 'success' end end status, case when not cut then round(secs, 6) end processing_time,
  cast(case when not cut then case when failed then 1 else 0 end end as integer) n_errors,
  case when cut then 'VOID' when doc_id % 3 = 0 then 'OBJECT' when doc_id % 3 = 1 then 'STRING' else 'VOID' end json_kind,
  case when not cut then '# ' || cast(doc_id as varchar) end md_content from r"""

ORACLE["response_select"] = _RESPONSES + """ select doc_id, case when cut then '' when failed then null
  when fmt in ('json', 'JSON') and doc_id % 3 = 0 then '{' || chr(10) || '  "id": ' || cast(doc_id as varchar) || ',' || chr(10) || '  "tags": [' || chr(10)
    || '    "a",' || chr(10) || '    "é"' || chr(10) || '  ]' || chr(10) || '}'
  when fmt in ('json', 'JSON') and doc_id % 3 = 1 then 'id ' || cast(doc_id as varchar)
  when fmt = 'html' then '<p>' || cast(doc_id as varchar) || '</p>' when fmt = 'text' then '' else '# ' || cast(doc_id as varchar) end content,
  case when not cut and failed then 'Conversion failed: ["parse error"]' end error, case when not cut then round(secs, 6) end processing_time from r"""

ORACLE["request_v1"] = """select doc_id, '{"sources":[' || case doc_id % 3
  when 0 then '{"kind":"http","url":"http://h/' || cast(doc_id as varchar) || '"}'
  when 1 then '{"kind":"http","url":"http://h/' || cast(doc_id as varchar) || '"},{"kind":"base64","base64_string":"QQ==","filename":"' || cast(doc_id as varchar) || '.pdf"}'
  else '{"kind":"http","url":"https://n/' || cast(doc_id as varchar) || '"},{"kind":"base64","base64_string":"QQ==","filename":"' || cast(doc_id as varchar) || '.pdf"}' end
  || '],"options":{"to":"md"}}' request from documents"""

ORACLE["pptx_to_markdown"] = "with " + F3 + f""" select path, string_agg(printf('## Slide %d', member_ix) || chr(10) || chr(10)
  || {unescaped("regexp_extract(content, '(?s)<a:t>(.*?)</a:t>', 1)")}, chr(10) || chr(10) order by member_ix) markdown
  from m where member_ix % 5 = 0 group by path"""

ORACLE["xlsx_to_cells"] = """select 'book_' || cast(p_partkey // 50 as varchar) || '.xlsx' path, cast(1 as integer) sheet, c || cast(p_partkey % 50 + 1 as varchar) cell_ref,
  cast(p_partkey % 50 as integer) row_ix, cast(ix as integer) col_ix,
  case c when 'A' then 'A&é ' || p_name when 'B' then cast(p_size as varchar) else 'i' || cast(p_partkey as varchar) end "value"
  from part, (values ('A', 0), ('B', 1), ('AA', 26)) t(c, ix)"""

ORACLE["stream_memlog"] = "select * exclude (line_no) from (" + MEMLOG["memlog_parse"] + ")"

# One batch reads all files, so everything up to the watermark is folded before old STARTs are reported.
_STREAMED = F1_TYPED.replace("e as (select * from e0 where log_type is not null)", "wm as (select max(ts) - interval 10 seconds wm from e0 where log_type is not null),\n"
                             "e as (select * from e0 where log_type is not null and ts <= (select wm from wm))")
ORACLE["stream_orphans"] = "with " + _STREAMED + """ select job_name, strftime(start_time, '%Y-%m-%d %H:%M:%S') start_time,
  round(rss_at_start, 6) rss_at_start, round(vms_at_start, 6) vms_at_start, round(memory_percent_at_start, 6) memory_percent_at_start,
  round(system_available_at_start, 6) system_available_at_start from orph where start_time + interval 300 seconds < (select wm from wm)"""

_SHEETS = """with x as (select p_partkey // 50 b, p_partkey % 50 r, 'A&é ' || p_name a, cast(p_size as varchar) s, 'i' || cast(p_partkey as varchar) i from part),
y as (select 'book_' || cast(b as varchar) || '.xlsx#1' table_id, cast(r - min(r) over (partition by b) as bigint) line_ix, a, s, i from x)"""

ORACLE["sheet_to_csv"] = _SHEETS + " select table_id, line_ix, a || ',' || s || ',' || i line from y"

ORACLE["sheet_to_markdown"] = _SHEETS + """ select table_id, line_ix, '| ' || a || ' | ' || s || ' | ' || i || ' |'
  || case when line_ix = 0 then chr(10) || '| --- | --- | --- |' else '' end line from y"""
