"""DuckDB oracle SQL for the batch-document queries."""

F5 = r"""
r as (select d.doc_id, 'in/' || source || '/' || cast(d.doc_id as varchar)
    || (['.pdf', '.DOCX', '.pptx', '.xlsx', '.png', '.html', '.md', '.zip'])[d.doc_id % 8 + 1] path,
  n_chars * 1000 size_bytes, coalesce(l.quality, 1) = 1 ok,
  case when coalesce(l.quality, 1) = 1 then n_chars % 4 else 0 end tables_found,
  case when coalesce(l.quality, 1) = 1 then d.doc_id % 3 else 0 end images_extracted,
  case when coalesce(l.quality, 1) = 1 then d.doc_id % 5 else 0 end page_images_extracted,
  cast(n_chars as double) / 100 run_seconds, cast(d.doc_id % 3 + 1 as integer) attempt,
  case when coalesce(l.quality, 1) = 1 then null when d.doc_id % 2 = 0 then 'terminate: Out of Memory' else 'parse error' end error_msg
  from documents d left join labels l on d.doc_id = l.doc_id),
f as (select *, regexp_extract(path, '([^/\\]*)$', 1) fname, regexp_extract(regexp_extract(path, '([^/\\]*)$', 1), '^.+(\.[^.]+)$', 1) sfx from r),
g as (select *, case lower(sfx) when '.pdf' then 'pdf' when '.docx' then 'docx' when '.pptx' then 'pptx' when '.xlsx' then 'xlsx'
  when '.png' then 'image' when '.jpg' then 'image' when '.jpeg' then 'image' when '.tiff' then 'image' when '.tif' then 'image'
  when '.bmp' then 'image' when '.webp' then 'image' when '.html' then 'html' when '.htm' then 'html' when '.md' then 'md'
  when '.markdown' then 'md' end format from f),
st as (select fname filename, path file_path, size_bytes / 1048576.0 file_size_mb, format, ok success,
  case when ok then tables_found else 0 end tables_found,
  case when ok then greatest(tables_found, greatest(tables_found - case when doc_id % 7 = 0 then 1 else 0 end, 0)) else 0 end tables_exported,
  case when ok then images_extracted else 0 end images_extracted, case when ok then page_images_extracted else 0 end page_images_extracted,
  round(run_seconds, 2) processing_time_seconds, case when not ok then error_msg end error from g)
"""


def _w(body):
    return "with " + F5 + body


URL = r"""with p as (select page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) upath from pages),
b as (select *, regexp_extract(upath, '([^/\\]*)$', 1) base from p),
e as (select *, case when lower(regexp_extract(base, '^\.*[^.].*(\.[^.]*)$', 1)) = '' then '.html'
  else lower(regexp_extract(base, '^\.*[^.].*(\.[^.]*)$', 1)) end ext, case when base = '' then 'downloaded_content' else base end nm from b)
select page_id, starts_with(url, 'http://') or starts_with(url, 'https://') is_url, ext extension,
  case when ends_with(nm, ext) then nm else nm || ext end filename from e"""

OFFICE = ("'powerpoint', 'ppt', 'pptx', 'excel', 'xls', 'xlsx', 'word', 'doc', 'docx'")

ORACLE = {
    "format_route": _w("select doc_id, path, format from g"),
    "format_dim_join": _w("select doc_id, lower(sfx) ext, format from g"),
    "office_type_route": _w(f"""select doc_id, office_type, case lower(office_type) when 'powerpoint' then '.pptx'
  when 'ppt' then '.pptx' when 'pptx' then '.pptx' when 'excel' then '.xlsx' when 'xls' then '.xlsx' when 'xlsx' then '.xlsx'
  when 'word' then '.docx' when 'doc' then '.docx' when 'docx' then '.docx' end extension,
  case when lower(office_type) not in ({OFFICE}) then 'Unsupported office type: ' || office_type ||
  '. Supported types: [{OFFICE.replace("'", "''")}]' end error from (select doc_id, regexp_replace(sfx, '^[.]', '') office_type from g)"""),
    "url_route": URL,
    "mb_size": _w("select doc_id, round(size_bytes / 1048576.0, 6) size_mb, round(size_bytes / 1024.0, 6) size_kb from g"),
    "output_name": _w("""select doc_id, stem || '.md' md_name, stem || '.pdf' pdf_name, stem || '.json' json_name from
  (select doc_id, case when sfx = '' then fname else left(fname, length(fname) - length(sfx)) end stem from g)"""),
    "lang_list": """select doc_id, array_to_string(list_transform(string_split(lang || ' , ' || source || ',en ', ','), lambda x: trim(x)), '|') langs
  from documents""",
    "valid_office_ext": _w("""select doc_id, lower(sfx) in ('.pptx', '.ppt', '.odp', '.xlsx', '.xls', '.ods', '.docx', '.doc', '.odt')
  valid from g"""),
    "large_file_flag": _w("select doc_id, size_bytes / 1048576.0 > 100 large from g"),
    "low_system_memory_flag": """select user_id run_id, arg_min(2000 - 4 * value, (cast(floor(epoch(ts)) as bigint), event_id)) < 1000
  low_memory from events group by user_id""",
    "doc_limits": _w("""select doc_id, case when size_bytes > 50000000 then 'file too large' when run_seconds > 60.0 then 'timeout' end
  limit_reason from g"""),
    "doc_run_stats": _w("""select filename, file_path, round(file_size_mb, 6) file_size_mb, format, success, tables_found,
  tables_exported, images_extracted, page_images_extracted, round(processing_time_seconds, 6) processing_time_seconds, error from st"""),
    "tables_exported": _w("select file_path, tables_exported from st"),
    "batch_summary": _w("""select count(*) total_files, count(*) filter (where success) successful, cast(sum(tables_found) as bigint)
  total_tables_extracted, cast(sum(images_extracted) as bigint) total_images_extracted, cast(sum(page_images_extracted) as bigint)
  total_page_images_extracted, round(sum(processing_time_seconds), 6) total_processing_time_seconds,
  count(*) - count(*) filter (where success) failed from st"""),
    "format_breakdown": _w("""select coalesce(format, 'None') format, count(*) count, count(*) filter (where success) success
  from st group by all"""),
    "conversion_counts": _w("""select count(*) total, count(*) filter (where success) successful,
  count(*) - count(*) filter (where success) failed from st
  where lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)) in ('.pptx', '.xlsx')"""),
    "batch_progress": _w("""select file_path, row_number() over (order by file_path) idx,
  printf('[%d/%d]', row_number() over (order by file_path), count(*) over ()) progress from st"""),
    "files_sorted": _w("select path from r"),
    "retry_outcome": """with a as (select doc_id, cast(k as integer) attempt, (doc_id + k) % 3 = 0 ok from documents, range(1, 5) t(k)
  where k <= doc_id % 4 + 1 and k <= 2)
select doc_id, count(*) attempts_made, count(*) filter (where ok) > 0 succeeded,
  coalesce(min(attempt) filter (where ok), max(attempt)) final_attempt from a group by doc_id""",
    "error_log_classify": _w("""select doc_id, case when error_msg is null or error_msg = '' then ''
  when contains(lower(error_msg), 'out of memory') or contains(lower(error_msg), 'cannot allocate')
  then 'OUT OF MEMORY detected in LibreOffice logs' else substr(error_msg, 1, 300) end error from r where not ok"""),
    "conversion_validate": _w("""select case when lower(sfx) in ('.pptx', '.ppt', '.odp', '.xlsx', '.xls', '.ods', '.docx', '.doc', '.odt')
  then 'accepted' else 'unsupported' end reason, size_bytes / 1048576.0 > 100 large_file, count(*) n from g group by all"""),
}
